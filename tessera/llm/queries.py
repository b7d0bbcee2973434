"""Queries of the problems on text and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.glyphs import look_alike_pairs
from tessera.llm.nearest import nearest_in_time
from tessera.llm.offensive import THRESHOLD, score_documents, source_rates
from tessera.llm.packing import fill_rates, pack_documents
from tessera.llm.tokens import token_ids
from tessera.llm.turns import speaker_turns
from tessera.runtime import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_turns(table(spark, sf_dir, "speech_segments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_in_time(table(spark, sf_dir, "subtitle_segments"), table(spark, sf_dir, "speech_segments"), "sample_id", "sub_id", "seg_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("prompt", "samples", "row_index", "prompt"), ("speech", "speech_segments", "seg_id", "text"), ("subtitle", "subtitle_segments", "sub_id", "text"))
    texts = None
    for field, name, key, text in fields:
        part = spread(table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(text).alias("text"))).withColumn("field_name", F.lit(field))
        texts = part if texts is None else texts.unionByName(part)
    return look_alike_pairs(texts, "field_name", "id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "capacities"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused share by capacity."""
    return fill_rates(p9_packed(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("offence_score") >= THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf_dir).select("doc_id", "source", "offence_score")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of offensive documents by source."""
    return source_rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p5_found, p8_ids, p9_packed, p9_fill, p10_found, p10_scores, p10_rates)}

ORACLE = {
    "p3_found": """
        WITH sub AS (SELECT DISTINCT sub_id, sample_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e
                     FROM subtitle_segments WHERE sample_id IS NOT NULL AND start_sec IS NOT NULL AND end_sec >= start_sec),
        seg AS (SELECT DISTINCT seg_id, sample_id, CAST(round(start_sec * 1000) AS BIGINT) AS t FROM speech_segments WHERE start_sec IS NOT NULL),
        pairs AS (SELECT sub_id, seg_id, row_number() OVER (PARTITION BY sub_id ORDER BY abs(t - s), t, seg_id) AS n
                  FROM sub JOIN seg USING (sample_id) WHERE abs(t - s) <= 800 AND t < e)
        SELECT sub_id, seg_id FROM pairs WHERE n = 1""",
}
