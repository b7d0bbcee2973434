"""Queries of the general data problems: packed fields, intervals, nested records, rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.timeops import to_ms
from tessera.operators.intervals import periods_and_gaps
from tessera.operators.nested import POSITIONS, nested_tables, subtype_table, supertype_keys, union_all, variant_counts
from tessera.operators.packed import split_packed
from tessera.operators.rejects import load_with_rejects
from tessera.queries import nested_sql
from tessera.runtime import spread, table

#: a longer gap is a break in the recording, not a gap
BREAK_MS = 600_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(spread(table(spark, sf_dir, "samples").select("row_index", "reference_images")), "row_index", "reference_images")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = [
        table(spark, sf_dir, name).select(F.lit(track).alias("track"), "sample_id", to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e"))
        for track, name in (("speech", "speech_segments"), ("subtitle", "subtitle_segments"))
    ]
    return periods_and_gaps(union_all(tracks), ["track", "sample_id"], "s", "e", BREAK_MS)


def _nested(spark: SparkSession, sf_dir: str, typed: bool = True) -> DataFrame:
    gold = spread(table(spark, sf_dir, "samples").select("row_index", "gold"))
    said = spread(table(spark, sf_dir, "predictions").select("pred_id", "prediction"))
    return union_all([nested_tables(gold, "gold", "row_index", "gold", typed), nested_tables(said, "prediction", "pred_id", "prediction", typed)])


def _records(spark: SparkSession, sf_dir: str, typed: bool = True) -> DataFrame:
    """The nested tables, each record once: repeated deliveries are dropped behind the parsing, where they are small."""
    return _nested(spark, sf_dir, typed).dropDuplicates(["record_kind", "record_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supertype_keys(_nested(spark, sf_dir, False))


def p6_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by variant."""
    return variant_counts(_records(spark, sf_dir, False))


def _typed_table(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """A subtype table with the key of the parent as one text, NULL for issues."""
    link = F.concat_ws(":", "record_kind", "record_id", *[F.col("parent")[p] for p in POSITIONS])
    rows = subtype_table(_records(spark, sf_dir), level)
    return rows.withColumn("parent_key", F.when(F.col("parent").isNotNull(), link)).drop("parent", "variant")


def p6_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed issue table."""
    return _typed_table(spark, sf_dir, "issue")


def p6_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed evidence table with the link to its issue."""
    return _typed_table(spark, sf_dir, "evidence")


def p6_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed observation table with the link to its evidence."""
    return _typed_table(spark, sf_dir, "obs")


def p6_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of alternatives with the link to their observation."""
    return _typed_table(spark, sf_dir, "alt")


def _lines(spark: SparkSession, sf_dir: str, cells: bool) -> DataFrame:
    return load_with_rejects(spread(table(spark, sf_dir, "prediction_lines").select("line_id", "file_name", "raw_line")), cells=cells)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, False).where(F.col("fail_reason").isNotNull()).select("line_id", "fail_reason").distinct()


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, True).where(F.col("fail_reason").isNull()).drop("fail_reason", "csv_error").dropDuplicates(["line_id"])


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records with their seven cells and the number of their issues."""
    return _loaded(spark, sf_dir).withColumn("predicted_issues", F.size("issues")).drop("issues")


def p7_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed predicted issues of the valid records."""
    rows = _loaded(spark, sf_dir).select("line_id", F.posexplode("issues").alias("at", "x"))
    return rows.select("line_id", (F.col("at") + 1).alias("issue_pos"), "x.*")


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p6_found, p6_variants, p6_issues, p6_evidence, p6_observations, p6_alternatives, p7_found, p7_loaded, p7_issues)}

ORACLE = nested_sql.ORACLE | {
    "p4_found": """
        WITH raw AS (
          SELECT 'speech' AS track, sample_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM speech_segments
          UNION ALL
          SELECT 'subtitle', sample_id, CAST(round(start_sec * 1000) AS BIGINT), CAST(round(end_sec * 1000) AS BIGINT) FROM subtitle_segments),
        ok AS (SELECT DISTINCT * FROM raw WHERE sample_id IS NOT NULL AND s IS NOT NULL AND e > s),
        reach AS (SELECT *, max(e) OVER (PARTITION BY track, sample_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
        isle AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY track, sample_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM reach),
        period AS (SELECT track, sample_id, n, min(s) AS s, max(e) AS e FROM isle GROUP BY ALL),
        nxt AS (SELECT *, lead(s) OVER (PARTITION BY track, sample_id ORDER BY n) AS next_s FROM period)
        SELECT track, sample_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM period
        UNION ALL
        SELECT track, sample_id, 'gap', e, next_s FROM nxt WHERE next_s IS NOT NULL AND next_s - e <= 600000""",
}
