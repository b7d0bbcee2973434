from __future__ import annotations

import os

import numpy as np
import pytest

from tessera.operators import vectors
from tessera.queries.timelines import QUERIES

DATA = "/root/testdata/sf0.001"


def _brute(ids, v, least: float) -> set[tuple]:
    u = v / np.linalg.norm(v, axis=1)[:, None]
    c = u @ u.T
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j] and c[i, j] >= least}


def test_all_pairs(spark):
    """No pair is lost across tiles; vectors without a cosine have no pairs."""
    v = np.random.default_rng(5).normal(size=(90, 6))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None] * 3), (1003, [1.0]), (None, [1.0] * 6), (1004, [float("nan")] * 6), (1005, [])]
    df = spark.createDataFrame(rows + odd, "i bigint, v array<double>")
    for tile in (7, 2048):
        got = [(r.left_id, r.right_id) for r in vectors.all_pairs(df, "i", "v", 0.3, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(range(90), v, 0.3)
    assert vectors.all_pairs(df.limit(0), "i", "v", 0.3).collect() == []


def test_all_pairs_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "i string, v array<float>")
    assert [tuple(r) for r in vectors.all_pairs(df, "i", "v", 0.5, 1).collect()] == [("a", "b", 1.0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_embedding_pairs_of_the_whole_table(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    got = {(r.left_id, r.right_id) for r in QUERIES["embedding_pairs"](spark, DATA).collect()}
    assert got == _brute(e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float), 0.2)


def test_block_extremes(spark):
    """The ends over all pairs of a block, across tiles; a block of one has none."""
    v = np.random.default_rng(6).normal(size=(60, 4))
    rows = [(i % 3 if i % 3 else None, i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9, 100, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "b int, i int, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for tile in (6, 2048):
        got = {r.block: (r.min_cosine, r.max_cosine) for r in vectors.block_extremes(df, "b", "i", "v", tile).collect()}
        assert set(got) == {None, 1, 2}
        for b in (None, 1, 2):
            own = u[(b or 0) :: 3]
            c = (own @ own.T)[np.triu_indices(len(own), 1)]
            assert np.allclose(got[b], (c.min(), c.max()))
    q = {r.block: r for r in vectors.block_quality(df, "b", "i", "v").collect()}
    assert q[9].members == 1 and q[9].min_cosine is None and q[1].min_cosine < q[1].mean_cosine < q[1].max_cosine


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_embedding_quality_has_the_ends(spark):
    assert {"min_cosine", "max_cosine"} <= set(QUERIES["embedding_quality"](spark, DATA).columns)
