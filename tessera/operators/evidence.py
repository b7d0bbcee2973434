"""Claims, verdicts, coverage and status of checks over evidence tables. Null evidence is never a negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geometry import time_range
from tessera.functions.jsonops import fingerprint
from tessera.functions.similarity import block_ratio
from tessera.functions.textops import compact_text
from tessera.operators.contracts import first_wins
from tessera.operators.intervals import overlaps

_MAX_DEPENDENCIES = 1_000
ISSUE = ["localizable", "confidence", "description", "issue_type", "time_range", "keyframe_sec", "bbox"]


def issue_fingerprint(digits: int = 64) -> Column:
    return fingerprint({c: F.coalesce(F.col(c), F.lit("")) for c in ISSUE}, None, digits)


def new_candidates(issues: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """Issues that no known issue of the group equals field by field, with candidate_id from 1 in order of pos."""
    left = issues.withColumn("_fp", issue_fingerprint())
    right = known.withColumn("_fp", issue_fingerprint()).select(group, "_fp").distinct()
    kept = left.join(right, [group, "_fp"], "left_anti").drop("_fp")
    order = kept.groupBy(group).agg(F.array_sort(F.collect_list("pos")).alias("_order"))
    return kept.join(order, group).withColumn("candidate_id", F.array_position("_order", F.col("pos")).cast("int")).drop("_order")


def exact_first(issues: DataFrame, group: str) -> DataFrame:
    """Order-preserving exact de-duplication by fingerprint."""
    return first_wins(issues.withColumn("fp", issue_fingerprint()), [group, "fp"], "pos").drop("fp")


def verdicts_for(candidates: DataFrame, verdicts: DataFrame, key: str, domain: tuple[str, ...] = ("supported", "contradicted", "inconclusive"), longest: int = 500) -> DataFrame:
    """One verdict a candidate: the first given, 'inconclusive' where none or one outside the domain is given; reasons
    cut to `longest` characters. verdicts: key, pos, verdict, reason."""
    first = first_wins(verdicts.select(key, "pos", "verdict", "reason"), [key], "pos").drop("pos")
    out = candidates.join(first, key, "left")
    return out.withColumn("verdict", F.when(F.col("verdict").isin(*domain), F.col("verdict")).otherwise("inconclusive")).withColumn("reason", F.substring("reason", 1, longest))


def apply_verdicts(issues: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Issues that were no candidates, and those found supported."""
    joined = issues.join(verdicts.select(key, "verdict"), key, "left")
    return joined.where(F.col("verdict").isNull() | (F.col("verdict") == "supported")).drop("verdict")


def covers(a: str, b: str, least: float = 0.72) -> Column:
    """Whether issue a covers issue b: equal types, closed overlap of times (unknown ones overlap), and texts that hold
    each other, share two second values or the quoted words, or are alike. The cheap tests stand first."""
    text = lambda s: compact_text(F.col(f"{s}.description"))
    ta, tb = time_range(F.col(f"{a}.time_range"), True), time_range(F.col(f"{b}.time_range"), True)
    near = overlaps(ta["start_sec"], ta["end_sec"], tb["start_sec"], tb["end_sec"], closed=True, null_is_true=True)
    seconds = lambda s: F.array_distinct(F.regexp_extract_all(F.col(f"{s}.description"), F.lit(r"(\d+(?:\.\d+)?)\s*(?:s\b|秒)"), F.lit(1)))
    quotes = lambda s: F.array_distinct(F.regexp_extract_all(F.col(f"{s}.description"), F.lit("[“\"]([^”\"]+)[”\"]"), F.lit(1)))
    facts = F.size(F.array_intersect(seconds(a), seconds(b))) >= 2
    shared = F.size(F.array_intersect(quotes(a), quotes(b))) >= F.least(F.lit(2), F.greatest(F.lit(1), F.size(quotes(b))))
    inside = F.contains(text(a), text(b)) | F.contains(text(b), text(a))
    cheap = (F.col(f"{a}.issue_type") == F.col(f"{b}.issue_type")) & near
    return cheap & (inside | facts | shared | F.when(cheap & ~inside, block_ratio(text(a), text(b), False) >= least).otherwise(F.lit(False)))


def preserve(final: DataFrame, required: DataFrame, group: str) -> DataFrame:
    """The final issues and every required one that none of the group's final issues covers, behind them.

    Issues are compared inside one group and type, both small by nature; the join is on (group, type)."""
    a, b = final.alias("a"), required.alias("b")
    hit = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.issue_type") == F.col("b.issue_type"))).where(covers("a", "b"))
    covered = hit.select(F.col(f"b.{group}").alias(group), F.col("b.pos").alias("pos")).distinct()
    extra = required.join(covered, [group, "pos"], "left_anti")
    return final.withColumn("origin", F.lit("final")).unionByName(extra.withColumn("origin", F.lit("required")))


def drop_jointly_covered(issues: DataFrame, group: str, parts: str = "parts") -> DataFrame:
    """Issues without the composites whose every part another issue of the group alone stands for. parts: ARRAY."""
    single = issues.where(F.size(parts) == 1).select(group, F.col(parts)[0].alias("part"), F.col("pos").alias("by"))
    need = issues.where(F.size(parts) > 1).select(group, "pos", F.explode(parts).alias("part"), F.size(parts).alias("n"))
    met = need.join(single, [group, "part"]).where(F.col("by") != F.col("pos")).groupBy(group, "pos", "n").agg(F.countDistinct("part").alias("met"))
    return issues.join(met.where(F.col("met") == F.col("n")).select(group, "pos"), [group, "pos"], "left_anti")


def check_status(results: DataFrame, dependencies: DataFrame, group: str, levels: list[str]) -> DataFrame:
    """Status of every check of every group over the tools it depends on.

    results: group, tool, status, level, issues (number); dependencies: check_name, tool. A check is 'ok' if any tool
    is, else 'failed' if any is, else 'not_applicable'; 'detected' only with issues of ok tools, 'not_detected' only
    if a tool is ok, else 'not_evaluable'; limitations list the tools that did not run, in order."""
    table = dependencies.select("check_name", "tool").distinct().limit(_MAX_DEPENDENCIES + 1).collect()
    if not 0 < len(table) <= _MAX_DEPENDENCIES:
        raise ValueError(f"the dependency table needs 1 to {_MAX_DEPENDENCIES} rows")
    pairs = F.array(*[F.struct(F.lit(r.check_name).alias("check_name"), F.lit(r.tool).alias("tool")) for r in sorted(table)])
    need = results.select(group).distinct().select(group, F.explode(pairs).alias("d")).select(group, "d.*").join(results, [group, "tool"], "left")
    ok = F.col("status") == "ok"
    status = F.when(F.bool_or(ok), "ok").when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("not_applicable")
    found = F.sum(F.when(ok, F.col("issues")).otherwise(0))
    level = F.max_by("level", F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level")))
    out = need.groupBy(group, "check_name").agg(status.alias("status"), found.alias("issues"), level.alias("level"), F.array_sort(F.collect_set(F.when(~ok | F.col("status").isNull(), F.col("tool")))).alias("limitations"))
    return out.withColumn("decision", F.when(F.col("status") != "ok", "not_evaluable").when(F.col("issues") > 0, "detected").otherwise("not_detected"))


def unpivot_stages(df: DataFrame, group: str, stages: list[str]) -> DataFrame:
    """Columns <stage>_status and <stage>_error as rows: group, tool, status, error."""
    rows = F.array(*[F.struct(F.lit(s).alias("tool"), F.col(f"{s}_status").alias("status"), F.col(f"{s}_error").alias("error")) for s in stages])
    return df.select(group, F.explode(rows).alias("r")).select(group, "r.*")


def binding_candidates(records: DataFrame, group: str, share: float = 0.68, margin: float = 0.70, least: float = 1.0) -> DataFrame:
    """The speaker each role is bound to: support by (role, speaker), the best by weight, its share and lead, and a list
    of reasons where it does not suffice. records: group, role, speaker, weight, turn."""
    by = records.groupBy(group, "role", "speaker").agg(F.sum("weight").alias("w"), F.countDistinct("turn").alias("turns"))
    best = by.groupBy(group, "role").agg(F.sum("w").alias("total"), F.min(F.struct((-F.col("w")).alias("n"), "speaker", "turns")).alias("b"))
    rest = by.join(best.select(group, "role", F.col("b.speaker").alias("_s")), [group, "role"]).where(F.col("speaker") != F.col("_s")).groupBy(group, "role").agg(F.max("w").alias("next"))
    out = best.join(rest, [group, "role"], "left").select(group, "role", F.col("b.speaker").alias("speaker"), (-F.col("b.n")).alias("weight"), F.col("b.turns").alias("turns"), F.try_divide(-F.col("b.n"), F.col("total")).alias("share"), (-F.col("b.n") - F.coalesce("next", F.lit(0.0))).alias("lead"))
    roles = out.groupBy(group, "speaker").agg(F.count(F.lit(1)).alias("roles"))
    reasons = F.array_compact(F.array(F.when(F.col("weight") < least, "weight"), F.when(F.col("share") < share, "share"), F.when(F.col("lead") < margin, "lead"), F.when(F.col("roles") > 1, "shared_speaker")))
    return out.join(roles, [group, "speaker"]).withColumn("reasons", reasons)


def first_pairs(pairs: DataFrame, group: str, left: str, right: str, order: str) -> DataFrame:
    """The first pair of each unordered pair of roles."""
    both = pairs.withColumn("pair", F.array_sort(F.array(left, right))).where(F.col(left) != F.col(right))
    return first_wins(both, [group, "pair"], order)


def token_segments(tokens: DataFrame, group: str) -> DataFrame:
    """Segments from tokens with times and speakers: spoken groups, joined with blanks between Latin words only; groups
    without a letter or digit are dropped. tokens: group, pos BIGINT, token, start_sec, end_sec, speaker."""
    from tessera.functions.textops import join_tokens
    from tessera.operators.runs import spoken_groups

    marked = tokens.withColumn("terminal", F.col("token").rlike("^[。！？!?.…]+$"))
    runs = spoken_groups(marked, group, "pos")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    out = runs.groupBy(group, "run_start").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.first("speaker").alias("speaker"), join_tokens(F.transform(ordered, lambda t: t["token"])).alias("text"))
    return out.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def number_events(segments: DataFrame, key: str) -> DataFrame:
    """Numbers in segments with the time of their place: interpolated by character position."""
    found = segments.select(key, "start_sec", "end_sec", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"([0-9][0-9,]*)"), F.lit(1))).alias("n", "raw"))
    at = F.expr("length(regexp_substr(text, concat('^(?:[^0-9]*[0-9][0-9,]*){', cast(n as string), '}[^0-9]*')))")
    # a number at the very head has nothing before it
    middle = (F.coalesce(at, F.lit(0)) + F.length("raw") / 2) / F.length("text")
    return found.select(key, (F.col("n") + 1).alias("ordinal"), F.regexp_replace("raw", ",", "").alias("digits"), (F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * middle).alias("at_sec"))
