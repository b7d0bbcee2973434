"""Matching records of two tables by nearest time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.timeops import to_ms

TOLERANCE_MS = 800


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, left_id: str, right_id: str, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """For each left row the right row of the same entity whose start is nearest to its own: left_id, right_id.

    Both tables need `entity`, their id, start_sec; left also end_sec. A left row needs entity, start and an end not
    below the start; candidates start before the left row's end and at most tolerance_ms from its start, before or
    after; of equally near ones the earlier, then the smaller id. Left rows without candidates are not listed; nulls
    and values that are no numbers match nothing; repeated deliveries change nothing; an empty table gives no rows;
    further columns, also of equal names, are not read.

    Starts are cut into buckets as wide as the tolerance; left rows meet the right rows of their own and both
    neighbouring buckets in one equi-join on (entity, bucket), so a long entity is spread over its buckets. The
    partner is kept by a map-side combined minimum.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms).cast("bigint")
    a = left.select(F.col(entity).alias("_e"), F.col(left_id).alias("_a"), to_ms(F.col("start_sec")).alias("_s"), to_ms(F.col("end_sec")).alias("_end"))
    a = a.where(F.col("_e").isNotNull() & F.col("_a").isNotNull() & (F.col("_end") >= F.col("_s")))
    a = a.withColumn("_b", F.explode(F.sequence(bucket("_s") - 1, bucket("_s") + 1)))
    b = right.select(F.col(entity).alias("_e"), F.col(right_id).alias("_id"), to_ms(F.col("start_sec")).alias("_t"))
    b = b.where(F.col("_e").isNotNull() & F.col("_id").isNotNull() & F.col("_t").isNotNull()).withColumn("_b", bucket("_t"))
    away = F.abs(F.col("_t") - F.col("_s"))
    pairs = a.join(b, ["_e", "_b"]).where((away <= tolerance_ms) & (F.col("_t") < F.col("_end")))
    best = pairs.groupBy("_a").agg(F.min(F.struct(away.alias("away"), F.col("_t"), F.col("_id"))).alias("best"))
    return best.select(F.col("_a").alias(left_id), F.col("best._id").alias(right_id))
