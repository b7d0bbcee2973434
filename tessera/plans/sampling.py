"""Plans of frames and budgets as tables; decoding itself happens outside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def frame_plan(clips: DataFrame, clip: str, duration: str, fps: float, most: int | None = None) -> DataFrame:
    """clip, frame (from 0), at_sec: frames at a rate clamped to 0.1..12, at most `most` evenly thinned ones."""
    rate = min(max(fps, 0.1), 12.0)
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) * rate).cast("int"))
    step = F.lit(1.0) if most is None else F.greatest(F.lit(1.0), n / most)
    frames = F.transform(F.sequence(F.lit(0), (F.least(n, F.lit(most or 2**30)) - 1).cast("int")), lambda i: F.struct(i.alias("frame"), (F.floor(i * step) / rate).alias("at_sec")))
    return clips.where(F.col(duration) > 0).select(clip, F.explode(frames).alias("f")).select(clip, "f.*")


def contact_range(start: Column, end: Column, duration: Column, fps: float, most: int = 48) -> Column:
    """STRUCT(start_sec, end_sec, frames, columns, rows) of a contact sheet, clamped to the clip."""
    a = F.least(F.greatest(start, F.lit(0.0)), duration)
    b = F.least(F.greatest(end, a), duration)
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((b - a) * fps).cast("int")))
    cols = F.ceil(F.sqrt(n)).cast("int")
    return F.struct(a.alias("start_sec"), b.alias("end_sec"), n.alias("frames"), cols.alias("columns"), F.ceil(n / cols).cast("int").alias("rows"))


def capacity_matrix(spark: SparkSession, duration: float, rates: list[float], budgets: list[int]) -> DataFrame:
    """Frames needed at each rate against each budget."""
    rows = [(r, b) for r in rates for b in budgets]
    df = spark.createDataFrame(rows, "fps double, budget int").withColumn("frames", F.ceil(F.lit(duration) * F.col("fps")).cast("int"))
    return df.withColumn("fits", F.col("frames") <= F.col("budget"))


def batch_of(position: Column, size: int) -> Column:
    """Batch number (from 0) of a 1-based position."""
    return F.floor((position - 1) / size).cast("int")


def sync_summary(tracks: DataFrame, video: str) -> DataFrame:
    """Mean offset (half to even), confidence and distance over the tracks of a video, and its quality band; a video
    without tracks has no row, one with unknown values NULLs."""
    c = F.avg("confidence")
    band = F.when(c >= 7, "excellent").when(c >= 5, "good").when(c >= 3, "fair").when(c.isNotNull(), "poor")
    return tracks.groupBy(video).agg(F.bround(F.avg("offset_frames"), 0).cast("int").alias("offset"), c.alias("confidence"), F.avg("min_dist").alias("min_dist"), band.alias("quality"))
