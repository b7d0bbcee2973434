from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tessera.functions.keys import packed_key, unpacked_key
from tessera.operators.intervals import periods_and_gaps


def test_keys_come_back(spark):
    values = [None, "", "a", "\u0001", "\u0002", "\u0002e", "\u0002s", "\u0002n", "a\u0001\u0002", "\u0001\u0001b"]
    rows = list(product(values, values))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("k", packed_key([F.col("a"), F.col("b")]))
    back = unpacked_key(F.col("k"), 2)
    got = df.select("a", "b", "k", back[0].alias("x"), back[1].alias("y")).collect()
    assert all((r.a, r.b) == (r.x, r.y) for r in got) and len({r.k for r in got}) == len(rows)


def test_periods_of_odd_ids(spark):
    df = spark.createDataFrame([("a\u0001b", "c", 0, 5), ("a", "b\u0001c", 3, 9), ("a\u0001b", "c", 4, 8)], "x string, y string, s bigint, e bigint")
    got = {tuple(r) for r in periods_and_gaps(df, ["x", "y"], "s", "e").collect()}
    assert got == {("a\u0001b", "c", "period", 0, 8), ("a", "b\u0001c", "period", 3, 9)}
