"""Streaming extensions: the batch operators' rules over file streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def session_counts(events: DataFrame, key: str, time: str, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key by event time: key, start, end, events. A stream in append mode gives a session when the
    watermark has closed it, one in complete mode all of them, the open ones as they are."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    out = rows.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def tumbling_values(events: DataFrame, time: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("_t", size).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), "events", "total")


def running_maximum(events: DataFrame, key: str, value: str) -> DataFrame:
    """Stateful operator: each time a key's maximum rises, a row with the new one (append mode)."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else None
        before = top
        for pdf in frames:
            if len(pdf):
                most = float(pdf["value"].max())
                top = most if top is None else max(top, most)
        if top is not None:
            state.update((top,))
            if top != before:
                yield pd.DataFrame({"key": [keys[0]], "top": [top]})

    rows = events.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, "key bigint, top double", "top double", "append", "NoTimeout")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into files of `path`: a folder for each micro-batch in append mode, so a
    batch that is run again replaces itself, and one folder that is replaced in complete mode."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/*")


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str) -> None:
    """Exactly-once by key: every micro-batch appends only keys the target lacks."""
    from tessera.sources.sinks import append_new

    q = stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
