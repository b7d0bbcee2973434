"""Sinks: staged directories, append with resume, partitioned packages, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def commit_staged(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options: str) -> None:
    """Write beside the target and rename into place; a target that exists is refused, a failed write leaves none."""
    fs, target = _fs(df, path)
    if fs.exists(target):
        raise FileExistsError(path)
    _, staging = _fs(df, f"{path}.staging")
    writer = df.write.mode("overwrite").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staging.toString())
    if not fs.rename(staging, target):
        raise OSError(f"cannot commit {path}")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows (JSON lines) whose key the target lacks: running it again adds nothing. Returns rows added."""
    fs, target = _fs(df, path)
    new = df.dropDuplicates([key])
    if fs.exists(target):
        new = new.join(df.sparkSession.read.schema(df.select(key).schema).json(path), key, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").json(path)
        return n
    finally:
        new.unpersist()


def import_records(df: DataFrame, sample: str, position: str) -> DataFrame:
    """import_key and JSON body of flat rows; nulls are left out of the body."""
    body = F.to_json(F.struct(F.struct(*[c for c in df.columns]).alias("fields")))
    return df.select(F.concat_ws(":", F.col(sample), F.col(position).cast("string")).alias("import_key"), body.alias("record"))


def report(df: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """One text line a row."""
    return df.select(F.format_string(template, *[F.col(c) for c in columns]).alias("line"))
