"""Queries of the core against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from tessera.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
#: one query or more of every family of operators; TESSERA_ALL_SQL=1 runs them all
FAMILIES = (
    "p4_found p6_found p6_issues p6_observations p7_found p7_loaded p7_issues check_decisions issue_new_candidates issue_without_composites issue_backed event_bindings word_segments speech_numbers "
    "sample_validation doc_last_ranges clip_frames run_staged_rows run_paths csv_roundtrip jsonl_roundtrip package_roundtrip stream_append caption_components caption_distinct stream_sessions "
    "event_in_order_matches event_span_groups event_robust event_windows fact_coverage doc_text_features label_orphans"
).split()
NAMES = sorted(ORACLE) if os.environ.get("TESSERA_ALL_SQL") else FAMILIES


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    cols = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLE[name]}")
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == [], (name, a)
