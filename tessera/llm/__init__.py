"""Operators on texts and transcripts for training data. Nothing outside this subpackage imports it."""

from tessera.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
