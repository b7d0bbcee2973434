"""Speech against subtitles: overlap components, their texts, and the differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.similarity import difference_kind, edits
from tessera.functions.textops import compact_text, language_family
from tessera.operators.components import connected_components
from tessera.operators.intervals import overlap_join


def overlap_components(speech: DataFrame, subtitles: DataFrame, entity: str, width: int) -> DataFrame:
    """Components of the bipartite overlap graph: node ('s:<id>' or 't:<id>') and component. Edges join the two
    timelines only. speech: seg_id, l_start, l_end; subtitles: sub_id, r_start, r_end."""
    pairs = overlap_join(speech.select(entity, "seg_id", "l_start", "l_end"), subtitles.select(entity, "sub_id", "r_start", "r_end"), [entity], width)
    return connected_components(pairs.select(F.concat(F.lit("s:"), "seg_id").alias("a"), F.concat(F.lit("t:"), "sub_id").alias("b")))


def component_texts(nodes: DataFrame, speech: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Heard and shown text of each component, by start and id, with the language family of both."""
    heard = speech.select(F.concat(F.lit("s:"), "seg_id").alias("node"), F.lit("heard").alias("side"), F.col("l_start").alias("at"), F.col("seg_id").alias("id"), "text")
    shown = subtitles.select(F.concat(F.lit("t:"), "sub_id").alias("node"), F.lit("shown").alias("side"), F.col("r_start").alias("at"), F.col("sub_id").alias("id"), "text")
    rows = nodes.join(heard.unionByName(shown), "node")
    text = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "id", "text")))), lambda x: x["text"]), " ")
    out = rows.groupBy("component").agg(text("heard").alias("heard"), text("shown").alias("shown"), F.min("at").alias("start"))
    return out.withColumn("heard_family", language_family(F.col("heard"))).withColumn("shown_family", language_family(F.col("shown")))


def text_differences(texts: DataFrame) -> DataFrame:
    """Components of one known language whose normalised texts differ: the edits, their kind and the error ratio."""
    same = texts.where((F.col("heard_family") == F.col("shown_family")) & (F.col("heard_family") != "unknown"))
    norm = same.withColumn("a", compact_text(F.col("heard"))).withColumn("b", compact_text(F.col("shown"))).where((F.col("a") != F.col("b")) & (F.col("a") != "") & (F.col("b") != ""))
    ops = norm.withColumn("ops", edits(F.col("a"), F.col("b")))
    return ops.select("component", "heard", "shown", "start", difference_kind(F.col("ops")).alias("kind"), F.size("ops").alias("edits"), (F.size("ops") / F.length("a")).alias("error_ratio"))
