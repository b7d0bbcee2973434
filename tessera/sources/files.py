"""File sources with contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: logical names of the sample table, in the order of its columns
SAMPLE_COLUMNS = ("sample_id", "prompt", "reference_images", "video", "feedback", "gold")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """CSV of text cells: UTF-8 with or without a byte order mark, header, quoted cells over several lines. With
    `columns` the header's width must match and the columns take these names; the schema is fixed, never inferred."""
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "inferSchema": False}
    df = spark.read.options(**options).csv(path)
    if columns is not None:
        if len(df.columns) != len(columns):
            raise ValueError(f"{len(df.columns)} columns, expected {len(columns)}")
        df = df.toDF(*columns)
    return df.na.fill("")


def cell(df: DataFrame, name: str):
    """The column, or '' where the table has no such column."""
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Valid objects as rows, and the lines that do not parse; blank lines are skipped."""
    typed = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select("value")


def read_packages(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a directory of sample packages: sample, document (file name without .json), content VARIANT (NULL
    where it does not parse)."""
    docs = spark.read.text(f"{root}/*/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{feff}", "").alias("value"))
    return docs.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("document"), F.try_parse_json("value").alias("content"))


def read_sidecars(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """Side-car texts by stem: stem, text."""
    docs = spark.read.text(f"{folder}/*{suffix}", wholetext=True)
    return docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("value").alias("text"))


def leaks(df: DataFrame, column: str, markers: list[str]) -> DataFrame:
    """Rows whose text holds a marker of ground truth."""
    return df.where(F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower(column), F.lower(m))))
