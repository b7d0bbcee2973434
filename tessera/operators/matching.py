"""Joins by time and place: largest overlap, vetoes and rescues by overlap, claims against evidence, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.intervals import overlap_join


def largest_overlap(items: DataFrame, turns: DataFrame, on: list[str], item_id: str, label: str, width: int, fallback: str | None = None) -> DataFrame:
    """For each item the label of the turn it overlaps most (ties: smaller pos): item_id, label.

    items need l_start, l_end; turns r_start, r_end, pos and the label. Items without a positive overlap take the
    fallback.
    """
    hits = overlap_join(items.select(*on, item_id, "l_start", "l_end"), turns.select(*on, "pos", label, "r_start", "r_end"), on, width)
    share = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    best = hits.groupBy(item_id).agg(F.max_by(label, F.struct(share, -F.col("pos"))).alias(label))
    return items.select(item_id).distinct().join(best, item_id, "left").select(item_id, F.coalesce(F.col(label), F.lit(fallback)).alias(label))


def overlapping_ids(left: DataFrame, right: DataFrame, on: list[str], left_id: str, width: int, condition: Column | None = None) -> DataFrame:
    """Distinct ids of left rows that overlap a right row (under a condition)."""
    hits = overlap_join(left, right, on, width)
    return (hits if condition is None else hits.where(condition)).select(left_id).distinct()


def veto(left: DataFrame, blocked: DataFrame, on: list[str], left_id: str, width: int, least_share: float = 0.5) -> DataFrame:
    """left with `vetoed_by`, the smallest blocked pos that overlaps at least least_share of the shorter interval, or
    NULL. blocked needs r_start, r_end, pos."""
    hits = overlap_join(left.select(*on, left_id, "l_start", "l_end"), blocked.select(*on, "pos", "r_start", "r_end"), on, width)
    share = (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")) / F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start"))
    first = hits.where(share >= least_share).groupBy(left_id).agg(F.min("pos").alias("vetoed_by"))
    return left.join(first, left_id, "left")


def veto_with_rescue(left: DataFrame, rejected: DataFrame, trusted: DataFrame, on: list[str], left_id: str, width: int) -> DataFrame:
    """Left rows that stay: those that overlap no rejected row, or also overlap a trusted one."""
    bad, good = overlapping_ids(left, rejected, on, left_id, width), overlapping_ids(left, trusted, on, left_id, width)
    return left.join(bad.join(good, left_id, "left_anti"), left_id, "left_anti")


def supported_by_calls(issues: DataFrame, calls: DataFrame, on: str, slack: float, keyframe: float, width: float = 8.0) -> DataFrame:
    """Issues that a call backs: times overlap within the slack, the call's frame is near the keyframe, and boxes, where
    both have one, overlap. issues: start_sec, end_sec, keyframe_sec, bx STRUCT; calls: c_start, c_end, c_at, cx STRUCT."""
    left = issues.withColumn("_key", F.monotonically_increasing_id()).withColumn("l_start", F.col("start_sec") - slack).withColumn("l_end", F.col("end_sec") + slack + 1e-9)
    right = calls.withColumn("r_start", F.col("c_start")).withColumn("r_end", F.greatest("c_end", F.col("c_start") + 1e-9))
    boxes = F.col("bx").isNull() | F.col("cx").isNull() | (
        (F.least("bx.x2", "cx.x2") > F.greatest("bx.x1", "cx.x1")) & (F.least("bx.y2", "cx.y2") > F.greatest("bx.y1", "cx.y1"))
    )
    near = F.col("keyframe_sec").isNull() | F.col("c_at").isNull() | (F.abs(F.col("keyframe_sec") - F.col("c_at")) <= keyframe)
    backed = overlap_join(left, right, [on], int(width)).where(boxes & near).select("_key").distinct()
    return left.join(backed, "_key", "left_semi").drop("_key", "l_start", "l_end")


def texts_heard(captions: DataFrame, speech: DataFrame, on: list[str], caption_id: str, width: int) -> DataFrame:
    """For each caption the overlapping speech texts, by start and pos, as one text: caption_id, heard, segments."""
    hits = overlap_join(captions.select(*on, caption_id, "l_start", "l_end"), speech.select(*on, "pos", "heard_text", "r_start", "r_end"), on, width)
    parts = F.array_sort(F.collect_list(F.struct("r_start", "pos", "heard_text")))
    return hits.groupBy(caption_id).agg(F.array_join(F.transform(parts, lambda p: p["heard_text"]), " ").alias("heard"), F.count(F.lit(1)).alias("segments"))


def same_text_elsewhere(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, within: int, width: int) -> DataFrame:
    """Left rows whose own text (column norm) stands, without overlap, at most `within` away on the right: the nearest
    such row (ties: smaller id): left_id, right_id, gap.

    Rows meet by entity, text and time bucket: a text said many times in a long clip meets its neighbours only."""
    wide = left.where(F.col("norm") != "").select(on, "norm", left_id, (F.col("l_start") - within - 1).alias("a"), (F.col("l_end") + within + 1).alias("b"), "l_start", "l_end")
    pairs = overlap_join(wide, right.select(on, "norm", right_id, "r_start", "r_end"), [on, "norm"], width, "a", "b")
    gap = F.greatest("l_start", "r_start") - F.least("l_end", "r_end")
    best = pairs.groupBy(left_id).agg(F.bool_or(gap < 0).alias("met"), F.min(F.when((gap >= 0) & (gap <= within), F.struct(gap.alias("gap"), F.col(right_id)))).alias("n"))
    return best.where(~F.col("met") & F.col("n").isNotNull()).select(left_id, F.col(f"n.{right_id}").alias(right_id), F.col("n.gap").alias("gap"))


def repair_coverage(claims: DataFrame, facts: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and facts to append: a row stays if it claims no known fact or is the first claimer of one.

    claims: group, pos, fact_ids ARRAY; facts: group, fact_id."""
    each = claims.select(group, "pos", F.explode("fact_ids").alias("fact_id")).join(facts.select(group, "fact_id").distinct(), [group, "fact_id"])
    first = each.groupBy(group, "fact_id").agg(F.min("pos").alias("pos"))
    claimed = each.select(group, "pos").distinct().withColumn("_known", F.lit(True))
    keep = claims.join(claimed, [group, "pos"], "left").join(first.select(group, "pos").distinct().withColumn("_first", F.lit(True)), [group, "pos"], "left")
    keep = keep.where(F.col("_known").isNull() | F.col("_first").isNotNull()).drop("_known", "_first")
    return keep, facts.join(first.select(group, "fact_id"), [group, "fact_id"], "left_anti")


def supported_claims(claims: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """claims with `missing`, the required pairs that the group's evidence lacks. claims: required ARRAY; evidence:
    group, pair."""
    known = evidence.groupBy(group).agg(F.collect_set("pair").alias("_known"))
    none = F.array().cast(evidence.schema["pair"].dataType.simpleString().join(("array<", ">")))
    return claims.join(known, group, "left").withColumn("missing", F.array_sort(F.array_except("required", F.coalesce("_known", none)))).drop("_known")


def winner_with_margin(scores: DataFrame, item: str, candidate: str, score: str, least: float = 0.55, margin: float = 0.10) -> DataFrame:
    """The best candidate of each item if its score reaches `least` and leads the next by `margin`; else NULL."""
    best = scores.groupBy(item).agg(F.max(F.struct(F.col(score).alias("s"), F.col(candidate).alias("c"))).alias("b"))
    rest = scores.join(best, item).where(F.col(candidate) != F.col("b.c")).groupBy(item).agg(F.max(score).alias("next"))
    ok = (F.col("b.s") >= least) & (F.col("b.s") - F.coalesce("next", F.lit(0.0)) >= margin)
    return best.join(rest, item, "left").select(item, F.when(ok, F.col("b.c")).alias(candidate), F.col("b.s").alias("score"), F.col("next"))
