from __future__ import annotations

from tessera.functions.textops import canonical_number


def test_long_numbers(spark):
    df = spark.createDataFrame([("1" * 18,), ("0" * 3 + "9" * 40,), ("0" * 30,)], "raw string")
    assert [r[0] for r in df.select(canonical_number(df["raw"])).collect()] == ["1" * 18, "9" * 40, None]
