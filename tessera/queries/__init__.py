"""Registered queries and their SQL."""

from tessera.queries import data, events, evidence, roundtrips, texts, timelines

_PARTS = (data, events, evidence, roundtrips, texts, timelines)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
