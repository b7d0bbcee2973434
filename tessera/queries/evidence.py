"""Queries over evidence: status of checks, verdicts, coverage, bindings, validation of rows, plans and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import geometry, jsonops, textops, validation
from tessera.functions.timeops import to_ms
from tessera.operators import contracts, dialogue, evidence, matching, mediachecks, roles, runs, vectors
from tessera.operators.intervals import overlaps
from tessera.operators.nested import nested_tables, subtype_table
from tessera.plans import drivers, rules, sampling
from tessera.plans.registry import Stages
from tessera.queries import nested_sql
from tessera.queries.nested_sql import text_of
from tessera.runtime import table

QUERIES = {}
ORACLE = {}

#: which tools a check rests on
CHECKS = {"visual": ["A", "B"], "audio": ["C"], "text": ["D", "E"], "all": ["A", "B", "C", "D", "E"]}


def _query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").select("pred_id", "row_index", "sample_id", "prediction_source", "prediction").dropDuplicates(["pred_id"])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").drop("logged_at").dropDuplicates(["row_index"])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_EVENTS = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues with the row they belong to and a position in it: record_kind, group, pos and the seven fields."""
    said, gold = _predictions(spark, sf_dir), _samples(spark, sf_dir)
    owner = said.select(F.col("pred_id").alias("record_id"), F.col("row_index").alias("group"))
    found = subtype_table(nested_tables(said, "prediction", "pred_id", "prediction"), "issue").join(owner, "record_id")
    known = subtype_table(nested_tables(gold, "gold", "row_index", "gold"), "issue").withColumn("group", F.col("record_id"))
    return found.unionByName(known).withColumn("pos", F.col("record_id") * 1000 + F.col("issue_pos"))


_FIELDS = {"localizable": ("可定位性", "localizable"), "confidence": ("置信度", "confidence"), "description": ("问题说明", "description"), "issue_type": ("问题类型", "issue_type"), "time_range": ("时间区间", "time_range"), "keyframe_sec": ("关键帧秒", "keyframe_sec"), "bbox": ("BBox", "bbox")}
_ISSUES = (
    f"{nested_sql.LEVELS}, owner AS (SELECT DISTINCT pred_id, row_index FROM predictions), fields AS (SELECT record_kind, record_id, coalesce(row_index, record_id) AS g, record_id * 1000 + issue_pos AS pos, issue_pos, "
    + ", ".join(f"coalesce({text_of('o', *n)}, '') AS {c}" for c, n in _FIELDS.items())
    + " FROM issue LEFT JOIN owner ON record_kind = 'prediction' AND pred_id = record_id)"
)
_SAME = " AND ".join(f"a.{c} = b.{c}" for c in _FIELDS)


# ---- checks and verdicts -------------------------------------------------------------------------------------------
_DEPENDS = ", ".join(f"('{c}', '{t}')" for c, tools in CHECKS.items() for t in tools)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tool (prediction source) says of each row."""
    said = _predictions(spark, sf_dir)
    found = nested_tables(said, "prediction", "pred_id", "prediction", typed=False).select(F.col("record_id").alias("pred_id"), F.size("issue").alias("issues"))
    rows = said.join(found, "pred_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    blank = F.coalesce(F.trim("prediction"), F.lit("")) == ""
    status = F.when(blank, "not_applicable").when((F.col("issues") > 0) | (F.trim("prediction") == "[]"), "ok").otherwise("failed")
    level = F.when(F.col("issues") >= 3, "strong").when(F.col("issues") >= 1, "medium").otherwise("weak")
    return rows.select("row_index", F.col("prediction_source").alias("tool"), status.alias("status"), level.alias("level"), "issues")


_RESULTS = f"""{nested_sql.LEVELS}, n AS (SELECT record_id, count(*) AS issues FROM issue WHERE record_kind = 'prediction' GROUP BY record_id),
    p AS (SELECT DISTINCT pred_id, row_index, prediction_source AS tool, prediction, coalesce(issues, 0) AS issues FROM predictions LEFT JOIN n ON record_id = pred_id),
    results AS (SELECT row_index, tool, issues, CASE WHEN coalesce(trim(prediction, ' '), '') = '' THEN 'not_applicable' WHEN issues > 0 OR trim(prediction, ' ') = '[]' THEN 'ok' ELSE 'failed' END AS status,
      CASE WHEN issues >= 3 THEN 'strong' WHEN issues >= 1 THEN 'medium' ELSE 'weak' END AS level FROM p)"""


@_query(f"""WITH RECURSIVE {_RESULTS}, dep(check_name, tool) AS (VALUES {_DEPENDS}),
    need AS (SELECT g.row_index, d.check_name, d.tool, r.status, r.issues, r.level FROM (SELECT DISTINCT row_index FROM results) g CROSS JOIN dep d LEFT JOIN results r ON r.row_index = g.row_index AND r.tool = d.tool),
    s AS (SELECT row_index, check_name, CASE WHEN bool_or(status = 'ok') THEN 'ok' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'not_applicable' END AS status,
      CAST(sum(CASE WHEN status = 'ok' THEN issues ELSE 0 END) AS BIGINT) AS issues, list_extract(['weak', 'medium', 'strong'], max(list_position(['weak', 'medium', 'strong'], level))) AS level,
      array_to_string(list_sort(list_distinct(list(tool) FILTER (status IS NULL OR status <> 'ok'))), ',') AS limitations FROM need GROUP BY ALL)
    SELECT row_index, check_name, status, issues, level, coalesce(limitations, '') AS limitations, CASE WHEN status <> 'ok' THEN 'not_evaluable' WHEN issues > 0 THEN 'detected' ELSE 'not_detected' END AS decision FROM s""")
def check_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every row: detected, not detected, or not evaluable, never a negative out of what is missing."""
    depends = spark.createDataFrame([(c, t) for c, tools in CHECKS.items() for t in tools], "check_name string, tool string")
    out = evidence.check_status(_results(spark, sf_dir), depends, "row_index", ["weak", "medium", "strong"])
    return out.withColumn("limitations", F.array_join("limitations", ",")).withColumn("issues", F.col("issues").cast("bigint"))


@_query(f"""WITH RECURSIVE {_RESULTS}, t AS (SELECT unnest(['A', 'B', 'C']) AS tool), g AS (SELECT DISTINCT row_index FROM results)
    SELECT g.row_index, t.tool, max(r.status) AS status, CASE WHEN max(r.status) = 'failed' THEN 'no JSON' END AS error FROM g CROSS JOIN t LEFT JOIN results r ON r.row_index = g.row_index AND r.tool = t.tool GROUP BY g.row_index, t.tool""")
def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row of stages a record, as rows of stages."""
    wide = _results(spark, sf_dir).groupBy("row_index").agg(*[F.max(F.when(F.col("tool") == t, F.col("status"))).alias(f"{t}_status") for t in "ABC"])
    wide = wide.select("*", *[F.when(F.col(f"{t}_status") == "failed", "no JSON").alias(f"{t}_error") for t in "ABC"])
    return evidence.unpivot_stages(wide, "row_index", list("ABC"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("offensive") == 1, "supported").when(F.col("offensive") == 0, "contradicted").otherwise("unsure")
    return table(spark, sf_dir, "review_labels").select("doc_id", F.struct("reviewed_at", "reviewer").alias("pos"), verdict.alias("verdict"), F.col("reviewer").alias("reason"))


_VERDICTS = "v AS (SELECT doc_id, reviewer, reviewed_at, CASE WHEN offensive = 1 THEN 'supported' WHEN offensive = 0 THEN 'contradicted' ELSE 'unsure' END AS verdict FROM review_labels), f AS (SELECT doc_id, arg_min(verdict, (reviewed_at, reviewer)) AS verdict, arg_min(reviewer, (reviewed_at, reviewer)) AS reason FROM v GROUP BY doc_id)"


@_query(f"WITH {_VERDICTS} SELECT doc_id, CASE WHEN verdict IN ('supported', 'contradicted') THEN verdict ELSE 'inconclusive' END AS verdict, reason FROM (SELECT doc_id FROM documents) LEFT JOIN f USING (doc_id)")
def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first verdict on each document; none, or one outside the domain, is inconclusive."""
    return evidence.verdicts_for(_documents(spark, sf_dir).select("doc_id"), _verdicts(spark, sf_dir), "doc_id").select("doc_id", "verdict", "reason")


@_query(f"WITH {_VERDICTS} SELECT d.doc_id FROM documents d LEFT JOIN f USING (doc_id) WHERE f.doc_id IS NULL OR verdict = 'supported'")
def label_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were no candidates, and those found supported."""
    first = contracts.first_wins(_verdicts(spark, sf_dir), ["doc_id"], "pos")
    return evidence.apply_verdicts(_documents(spark, sf_dir).select("doc_id"), first, "doc_id")


@_query(f"""WITH RECURSIVE {_ISSUES}, a AS (SELECT * FROM fields WHERE record_kind = 'prediction'), b AS (SELECT * FROM fields WHERE record_kind = 'gold'), c AS (SELECT a.g, a.pos FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.g = b.g AND {_SAME}))
    SELECT g AS row_index, pos, CAST(row_number() OVER (PARTITION BY g ORDER BY pos) AS INT) AS candidate_id FROM c""")
def issue_new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted issues that the gold of the row does not hold field by field, numbered."""
    i = _issues(spark, sf_dir)
    out = evidence.new_candidates(i.where("record_kind = 'prediction'"), i.where("record_kind = 'gold'"), "group")
    return out.select(F.col("group").alias("row_index"), "pos", "candidate_id")


@_query(f"WITH RECURSIVE {_ISSUES} SELECT g AS row_index, min(pos) AS pos FROM fields WHERE record_kind = 'prediction' GROUP BY g, {', '.join(_FIELDS)}")
def issue_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal issues of a row, over all its sources."""
    return evidence.exact_first(_issues(spark, sf_dir).where("record_kind = 'prediction'"), "group").select(F.col("group").alias("row_index"), "pos")


@_query(f"""WITH RECURSIVE {nested_sql.LEVELS}, p AS (SELECT i.record_id, i.issue_pos, list_sort(list_distinct(list({text_of('e.o', '工具', 'tool')}) FILTER ({text_of('e.o', '工具', 'tool')} IS NOT NULL))) AS parts
      FROM issue i JOIN evidence e USING (record_kind, record_id, issue_pos) WHERE record_kind = 'prediction' GROUP BY ALL),
    one AS (SELECT record_id, issue_pos, parts[1] AS part FROM p WHERE len(parts) = 1), many AS (SELECT record_id, issue_pos, unnest(parts) AS part FROM p WHERE len(parts) > 1),
    met AS (SELECT m.record_id, m.issue_pos, bool_and(EXISTS (SELECT 1 FROM one WHERE one.record_id = m.record_id AND one.part = m.part AND one.issue_pos <> m.issue_pos)) AS all_met FROM many m GROUP BY ALL)
    SELECT record_id, CAST(issue_pos AS INT) AS pos, array_to_string(parts, ',') AS tools FROM p WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.record_id = p.record_id AND met.issue_pos = p.issue_pos AND all_met)""")
def issue_without_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with evidence, without those whose every tool another issue alone stands for."""
    e = subtype_table(nested_tables(_predictions(spark, sf_dir), "prediction", "pred_id", "prediction"), "evidence")
    parts = e.groupBy("record_id", F.col("issue_pos").alias("pos")).agg(F.array_sort(F.collect_set("tool")).alias("parts"))
    return evidence.drop_jointly_covered(parts, "record_id").select("record_id", "pos", F.array_join("parts", ",").alias("tools"))


@_query()
def issue_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of source A of each row, and those of the others that none of A's covers."""
    i = _issues(spark, sf_dir).where("record_kind = 'prediction'").join(_predictions(spark, sf_dir).select(F.col("pred_id").alias("record_id"), "prediction_source"), "record_id")
    rows = i.select("group", "pos", "prediction_source", *evidence.ISSUE)
    kept = evidence.preserve(rows.where("prediction_source = 'A'"), rows.where("prediction_source <> 'A'"), "group")
    return kept.select(F.col("group").alias("row_index"), "pos", "origin")


# ---- joins of claims and evidence ----------------------------------------------------------------------------------
@_query("""WITH a AS (SELECT DISTINCT row_index, sample_id FROM samples), b AS (SELECT DISTINCT row_index, sample_id FROM predictions)
    SELECT coalesce(a.row_index, b.row_index) AS row_index, a.sample_id AS left_key, b.sample_id AS right_key FROM a FULL JOIN b USING (row_index) WHERE a.sample_id IS DISTINCT FROM b.sample_id""")
def sample_misaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which samples and predictions name different clips."""
    said = _predictions(spark, sf_dir).select("row_index", "sample_id").distinct()
    return contracts.aligned_join(_samples(spark, sf_dir).select("row_index", "sample_id"), said, "row_index", "sample_id")[1]


_BOX = "[0-9.]+"
_NUM = lambda c, g: f"TRY_CAST(nullif(regexp_extract({c}, '([0-9.]+)\\s*,\\s*([0-9.]+)\\s*,\\s*([0-9.]+)\\s*,\\s*([0-9.]+)', {g}), '') AS DOUBLE)"
_SPAN = "^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*[-–—~]\\s*(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*$"
_SEC = lambda c, g: f"TRY_CAST(nullif(regexp_extract({c}, '{_SPAN}', {g}), '') AS DOUBLE)"


@_query(f"""WITH RECURSIVE {_ISSUES}, s AS (SELECT DISTINCT pred_id, sample_id FROM predictions),
    i AS (SELECT record_id, issue_pos, sample_id, {_SEC('time_range', 1)} AS a, {_SEC('time_range', 2)} AS b, {_NUM('bbox', 1)} AS x1, {_NUM('bbox', 2)} AS y1, {_NUM('bbox', 3)} AS x2, {_NUM('bbox', 4)} AS y2 FROM fields JOIN s ON pred_id = record_id WHERE record_kind = 'prediction'),
    k AS (SELECT *, coalesce(x1 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1 AND x2 <= 1 AND y2 <= 1, false) AS boxed FROM i WHERE b >= a),
    c AS (SELECT DISTINCT sub_id, sample_id, start_sec AS cs, greatest(end_sec, start_sec + 1e-9) AS ce, bbox FROM subtitle_segments WHERE start_sec IS NOT NULL)
    SELECT record_id, CAST(issue_pos AS INT) AS issue_pos FROM k WHERE EXISTS (SELECT 1 FROM c WHERE c.sample_id = k.sample_id AND least(b + 0.5 + 1e-9, ce) > greatest(a - 0.5, cs)
      AND (NOT boxed OR c.bbox IS NULL OR (least(x2, c.bbox.x2) > greatest(x1, c.bbox.x1) AND least(y2, c.bbox.y2) > greatest(y1, c.bbox.y1))))""")
def issue_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted issues that a subtitle shown within half a second, and in the same place, backs."""
    i = _issues(spark, sf_dir).where("record_kind = 'prediction'").join(_predictions(spark, sf_dir).select(F.col("pred_id").alias("record_id"), "sample_id"), "record_id")
    span = geometry.time_range(F.col("time_range"), True)
    left = i.select("sample_id", "record_id", "issue_pos", span["start_sec"].alias("start_sec"), span["end_sec"].alias("end_sec"), F.lit(None).cast("double").alias("keyframe_sec"), geometry.bbox_bounds(F.col("bbox")).alias("bx")).where("start_sec IS NOT NULL")
    calls = table(spark, sf_dir, "subtitle_segments").where("start_sec IS NOT NULL").select("sample_id", F.col("start_sec").alias("c_start"), F.col("end_sec").alias("c_end"), F.lit(None).cast("double").alias("c_at"), F.col("bbox").alias("cx"))
    return matching.supported_by_calls(left, calls, "sample_id", 0.5, 0.5).select("record_id", "issue_pos")


@_query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS score FROM n),
    b AS (SELECT user_id, max(score) AS score, arg_max(event_type, (score, event_type)) AS c FROM s GROUP BY user_id), r AS (SELECT s.user_id, max(s.score) AS next FROM s JOIN b ON s.user_id = b.user_id AND s.event_type <> b.c GROUP BY s.user_id)
    SELECT user_id, CASE WHEN score >= 0.22 AND score - coalesce(next, 0) >= 0.02 THEN c END AS event_type, CAST(round(score * 10000) AS INT) AS score, CAST(round(next * 10000) AS INT) AS next FROM b LEFT JOIN r USING (user_id)""")
def event_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that clearly leads among each user's events, if one does."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    scores = n.join(n.groupBy("user_id").agg(F.sum("n").alias("all")), "user_id").select("user_id", "event_type", (F.col("n") / F.col("all")).alias("score"))
    out = matching.winner_with_margin(scores, "user_id", "event_type", "score", 0.22, 0.02)
    return out.select("user_id", "event_type", *[F.round(F.col(c) * 10000).cast("int").alias(c) for c in ("score", "next")])


@_query("""WITH d AS (SELECT sample_id, doc_kind FROM documents WHERE sample_id IS NOT NULL), c AS (SELECT DISTINCT sample_id FROM d)
    SELECT sample_id, concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.sample_id = c.sample_id AND doc_kind = 'feedback') THEN 'feedback' END, CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.sample_id = c.sample_id AND doc_kind = 'prompt') THEN 'prompt' END) AS missing FROM c""")
def sample_claims_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sample needs and has no document for."""
    d = _documents(spark, sf_dir).where("sample_id IS NOT NULL")
    claims = d.select("sample_id").distinct().withColumn("required", F.array(F.lit("prompt"), F.lit("feedback")))
    return matching.supported_claims(claims, d.select("sample_id", F.col("doc_kind").alias("pair")), "sample_id").select("sample_id", F.array_join("missing", ",").alias("missing"))


@_query(f"""WITH {_EVENTS}, b AS (SELECT user_id, event_type AS role, 's' || k % 3 AS speaker, sum(value) AS w, count(DISTINCT event_id) AS turns FROM e GROUP BY ALL),
    t AS (SELECT user_id, role, sum(w) AS total, arg_min(speaker, (-w, speaker)) AS speaker, max(w) AS weight, arg_min(turns, (-w, speaker)) AS turns FROM b GROUP BY ALL),
    r AS (SELECT b.user_id, b.role, max(b.w) AS next FROM b JOIN t ON b.user_id = t.user_id AND b.role = t.role AND b.speaker <> t.speaker GROUP BY ALL),
    o AS (SELECT t.*, weight / total AS share, weight - coalesce(next, 0) AS lead FROM t LEFT JOIN r USING (user_id, role)), n AS (SELECT user_id, speaker, count(*) AS roles FROM o GROUP BY ALL)
    SELECT user_id, role, speaker, CAST(round(weight * 100) AS BIGINT) AS weight, turns, CAST(round(share * 10000) AS INT) AS share, roles,
      concat_ws(',', CASE WHEN weight < 1.0 THEN 'weight' END, CASE WHEN share < 0.68 THEN 'share' END, CASE WHEN lead < 0.7 THEN 'lead' END, CASE WHEN roles > 1 THEN 'shared_speaker' END) AS reasons FROM o JOIN n USING (user_id, speaker)""")
def event_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speaker each role of a user would be bound to, and why it may not be."""
    e = _events(spark, sf_dir).select("user_id", F.col("event_type").alias("role"), F.concat(F.lit("s"), F.col("k") % 3).alias("speaker"), F.col("value").alias("weight"), F.col("event_id").alias("turn"))
    out = evidence.binding_candidates(e, "user_id")
    return out.select("user_id", "role", "speaker", F.round(F.col("weight") * 100).cast("bigint").alias("weight"), "turns", F.round(F.col("share") * 10000).cast("int").alias("share"), "roles", F.array_join("reasons", ",").alias("reasons"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs.numbered(_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), "event_id", "event_type"), "user", ["event_id"])
    w = runs.windows(e.select("user", "sequence", "event_type", "event_id"), "user", "sequence", 2, ["event_type", "event_id"])
    return w.select("user", F.col("window")[0]["event_type"].alias("a"), F.col("window")[1]["event_type"].alias("b"), F.col("window")[0]["event_id"].alias("order"))


@_query("""WITH w AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), p AS (SELECT user_id, least(a, b) || '/' || greatest(a, b) AS pair, a, b, event_id FROM w WHERE b IS NOT NULL AND a <> b)
    SELECT CAST(user_id AS VARCHAR) AS "user", pair, arg_min(a, event_id) AS a, arg_min(b, event_id) AS b, min(event_id) AS "order" FROM p GROUP BY ALL""")
def event_first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time two types follow each other in a user's events, in either order."""
    return evidence.first_pairs(_pairs(spark, sf_dir), "user", "a", "b", "order").select("user", F.array_join("pair", "/").alias("pair"), "a", "b", "order")


# ---- words and numbers in time -------------------------------------------------------------------------------------
@_query("""WITH s AS (SELECT DISTINCT seg_id, speaker, words FROM speech_segments), t AS (SELECT CAST(seg_id AS VARCHAR) AS seg, speaker, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM s),
    k AS (SELECT seg, pos, speaker, w.text AS token, w.start_sec AS a, w.end_sec AS b, regexp_full_match(w.text, '[。！？!?.…]+') AS terminal FROM t WHERE w.text IS NOT NULL AND w.start_sec IS NOT NULL AND w.end_sec IS NOT NULL),
    f AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR lag(terminal) OVER o OR (a - lag(b) OVER o > 0.24 AND NOT terminal) THEN 1 ELSE 0 END AS n FROM k WINDOW o AS (PARTITION BY seg ORDER BY pos)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY seg ORDER BY pos) AS grp FROM f),
    j AS (SELECT seg, min(pos) AS run_start, min(a) AS start_sec, max(b) AS end_sec, string_agg(token, chr(1) ORDER BY pos) AS raw FROM g GROUP BY seg, grp)
    SELECT seg, CAST(run_start AS BIGINT) AS run_start, start_sec, end_sec, replace(regexp_replace(regexp_replace(raw, '([A-Za-z0-9])\\x01([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])\\x01([A-Za-z0-9])', '\\1 \\2', 'g'), chr(1), '') AS text FROM j WHERE regexp_matches(raw, '[\\p{L}\\p{N}]')""")
def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments put together again from the words of each transcript row."""
    s = table(spark, sf_dir, "speech_segments").dropDuplicates(["seg_id"]).select(F.col("seg_id").cast("string").alias("seg"), "speaker", F.posexplode("words").alias("p", "w"))
    tokens = s.select("seg", "speaker", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("w.text").alias("token"), F.col("w.start_sec").alias("start_sec"), F.col("w.end_sec").alias("end_sec"))
    tokens = tokens.where("token IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL").withColumn("speaker", F.coalesce("speaker", F.lit("")))
    return evidence.token_segments(tokens, "seg").select("seg", F.col("run_start").cast("bigint").alias("run_start"), "start_sec", "end_sec", "text")


@_query("""WITH s AS (SELECT DISTINCT seg_id, start_sec, end_sec, text FROM speech_segments WHERE text IS NOT NULL), n AS (SELECT *, unnest(regexp_extract_all(text, '[0-9][0-9,]*')) AS raw, generate_subscripts(regexp_extract_all(text, '[0-9][0-9,]*'), 1) AS ordinal FROM s)
    SELECT seg_id, CAST(ordinal AS INT) AS ordinal, replace(raw, ',', '') AS digits, CAST(round((start_sec + (end_sec - start_sec) * ((length(regexp_extract(text, '^(?:[^0-9]*[0-9][0-9,]*){' || (ordinal - 1) || '}[^0-9]*')) + length(raw) / 2) / length(text))) * 1000) AS BIGINT) AS at_ms FROM n""")
def speech_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are spoken, each with the time of its place in the text."""
    s = table(spark, sf_dir, "speech_segments").dropDuplicates(["seg_id"]).where("text IS NOT NULL")
    return evidence.number_events(s, "seg_id").select("seg_id", "ordinal", "digits", F.round(F.col("at_sec") * 1000).cast("bigint").alias("at_ms"))


@_query("""WITH s AS (SELECT DISTINCT seg_id, sample_id, speaker, start_sec, end_sec FROM speech_segments WHERE sample_id IS NOT NULL AND start_sec IS NOT NULL),
    w AS (SELECT sample_id, seg_id, lead(seg_id) OVER o AS next_id, end_sec, speaker, lead(start_sec) OVER o AS ns, lead(speaker) OVER o AS nspk FROM s WINDOW o AS (PARTITION BY sample_id ORDER BY CAST(round(start_sec * 1000) AS BIGINT), seg_id))
    SELECT seg_id, next_id, (ns - end_sec <= 1.25) AND NOT (speaker IS NOT NULL AND nspk IS NOT NULL AND speaker <> nspk) AS compatible FROM w WHERE next_id IS NOT NULL""")
def speech_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring segments of a clip, and whether they may share a context."""
    s = table(spark, sf_dir, "speech_segments").where("sample_id IS NOT NULL AND start_sec IS NOT NULL").dropDuplicates(["seg_id"])
    n = runs.numbered(s.select("sample_id", to_ms(F.col("start_sec")).alias("ms"), "seg_id", "speaker", "start_sec", "end_sec"), "sample_id", ["ms", "seg_id"])
    w = runs.windows(n, "sample_id", "sequence", 2, ["seg_id", "speaker", "start_sec", "end_sec"])
    a, b = F.col("window")[0], F.col("window")[1]
    return w.select(a["seg_id"].alias("seg_id"), b["seg_id"].alias("next_id"), runs.compatible_neighbours(a, b).alias("compatible"))


# ---- validation ----------------------------------------------------------------------------------------------------
_TRIMMED = lambda c: f"trim({c}, ' ')"
_HAS = lambda c: f"coalesce(trim({c}, ' ') <> '', false)"


@_query(f"""WITH s AS (SELECT DISTINCT row_index, sample_id, prompt, reference_images, video, feedback, gold FROM samples), j AS (SELECT *, list_filter([lower({_TRIMMED('prompt')}), lower({_TRIMMED('feedback')})], lambda x: x IS NOT NULL AND x <> '') AS filled FROM s)
    SELECT row_index, concat_ws(',', CASE WHEN NOT {_HAS('sample_id')} THEN 'id' END, CASE WHEN NOT coalesce(length({_TRIMMED('prompt')}) >= 20, false) THEN 'prompt' END, CASE WHEN NOT coalesce(starts_with(video, '/data/'), false) THEN 'video' END) AS broken,
      CASE WHEN NOT {_HAS('sample_id')} THEN 'id' WHEN NOT coalesce(length({_TRIMMED('prompt')}) >= 20, false) THEN 'prompt' WHEN NOT coalesce(starts_with(video, '/data/'), false) THEN 'video' END AS first_broken,
      len(filled) > 0 AND len(list_filter(filled, lambda x: NOT (x IN ('无', 'n/a') OR regexp_full_match(x, 'test[0-9]*|[-.]+')))) = 0 AS junk,
      {_HAS('feedback')} AS any_feedback, {_HAS('reference_images')} AS has_images, {_HAS('video')} AS has_video,
      concat_ws(',', CASE WHEN coalesce(regexp_matches(feedback, '画面|video'), false) AND NOT {_HAS('video')} THEN 'video' END, CASE WHEN coalesce(regexp_matches(prompt, '图'), false) AND NOT {_HAS('reference_images')} THEN 'images' END) AS missing,
      regexp_matches(prompt, '字幕') AND NOT regexp_matches(prompt, '(?:不要|先不).{{0,20}}?(?:字幕)') AS wants_caption,
      CASE WHEN instr(prompt, '图') > 0 THEN substr(prompt, greatest(instr(prompt, '图') - 24, 1), instr(prompt, '图') - greatest(instr(prompt, '图') - 24, 1) + 1 + 120) END AS around_image,
      CASE WHEN NOT coalesce(json_valid(gold), false) AND {_HAS('gold')} THEN 'gold: no JSON in row ' || row_index END AS gold_error,
      coalesce(nullif(feedback, ''), nullif(prompt, ''), '') AS said FROM j""")
def sample_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of each sample: what breaks, what is junk, what is provided and what is missing."""
    s = _samples(spark, sf_dir)
    c = F.col
    gates = [("id", F.trim("sample_id") != ""), ("prompt", F.length(F.trim("prompt")) >= 20), ("video", c("video").startswith("/data/"))]
    given = validation.provided({"images": c("reference_images"), "video": c("video")})
    needs = {"video": (c("feedback").rlike("画面|video"), given["video"]), "images": (c("prompt").rlike("图"), given["images"])}
    return s.select(
        "row_index", F.array_join(validation.violations(gates), ",").alias("broken"), rules.reject_reason(gates).alias("first_broken"), validation.only_junk([c("prompt"), c("feedback")], ["无", "n/a"], "test[0-9]*|[-.]+").alias("junk"),
        validation.any_alias_filled(s, ["Feedback", "user_feedback"]).alias("any_feedback"), given["images"].alias("has_images"), given["video"].alias("has_video"), F.array_join(validation.missing_needs(needs), ",").alias("missing"),
        validation.required_clause(c("prompt"), "字幕", ["不要", "先不"]).alias("wants_caption"), validation.around(c("prompt"), F.lit("图")).alias("around_image"), validation.json_or_error(c("gold"), "gold", c("row_index"))["error"].alias("gold_error"),
        contracts.first_filled(c("feedback"), c("prompt")).alias("said"),
    )


@_query("""WITH p AS (SELECT DISTINCT pred_id, prediction FROM predictions), t AS (SELECT pred_id, bool_or(j.atom IS NOT NULL AND (j.type <> 'VARCHAR' OR regexp_matches(j.atom->>'$', '\\S'))) AS filled FROM p, json_tree(CASE WHEN json_valid(prediction) THEN prediction END) j GROUP BY pred_id)
    SELECT pred_id, CASE WHEN prediction IS NULL THEN false WHEN json_valid(prediction) THEN coalesce(filled, false) ELSE regexp_matches(prediction, '\\S') END AS filled, length(regexp_extract(prediction, '(?s)(\\[.*\\])', 1)) AS array_slice, length(regexp_extract(prediction, '(?s)(\\{.*\\})', 1)) AS object_slice FROM p LEFT JOIN t USING (pred_id)""")
def prediction_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a prediction holds anything at all, and the outermost array and object in it."""
    p = _predictions(spark, sf_dir)
    c = F.col("prediction")
    return p.select("pred_id", F.coalesce(validation.has_content(c), F.lit(False)).alias("filled"), F.length(jsonops.array_slice(c)).alias("array_slice"), F.length(jsonops.object_slice(c)).alias("object_slice"))


@_query(f"""WITH p AS (SELECT DISTINCT pred_id, prediction AS t FROM predictions), k AS (SELECT pred_id, CASE WHEN {nested_sql.strict('t')} THEN CASE WHEN json_type(t) = 'ARRAY' THEN from_json(t, '["json"]') END END AS l FROM p)
    SELECT pred_id, len(l) AS n, l[1]->>'问题类型' AS first_type FROM k WHERE l IS NOT NULL AND len(list_filter(l, lambda x: json_type(x) IS DISTINCT FROM 'OBJECT')) = 0""")
def prediction_object_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that are arrays of objects only, as structs of a fixed schema."""
    a = jsonops.object_array(F.col("prediction"), "struct<`问题类型`:string>")
    p = _predictions(spark, sf_dir).select("pred_id", a.alias("a")).where("a IS NOT NULL")
    return p.select("pred_id", F.size("a").cast("bigint").alias("n"), F.try_element_at("a", F.lit(1))["问题类型"].alias("first_type"))


@_query("""WITH d AS (SELECT doc_id, doc_kind, lang, source FROM documents) SELECT doc_id, doc_kind || chr(10) || coalesce(lang, '-') AS content,
    '{"kind":"' || doc_kind || '","lang":"' || coalesce(lang, '-') || '","tool":"reader"}' AS merged, concat_ws(',', CASE WHEN doc_kind <> '' THEN doc_kind END, CASE WHEN trim(coalesce(lang, ''), ' ') NOT IN ('', doc_kind) THEN trim(lang, ' ') END) AS cleaned FROM d""")
def doc_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content parts as text, merged maps with keys in order, and cleaned lists."""
    c = F.col
    lang = F.coalesce("lang", F.lit("-"))
    parts = F.try_parse_json(F.to_json(F.array(F.struct(c("doc_kind").alias("text")), F.struct(lang.alias("text")))))
    merged = jsonops.sorted_map(jsonops.merge_maps(F.create_map(F.lit("tool"), F.lit("other"), F.lit("lang"), lang), F.create_map(F.lit("tool"), F.lit("reader"), F.lit("kind"), c("doc_kind"))))
    cleaned = validation.clean_strings(F.array(c("doc_kind"), F.concat(F.lit(" "), c("lang")), c("doc_kind")), True)
    return _documents(spark, sf_dir).select("doc_id", jsonops.content_text(parts).alias("content"), F.to_json(merged).alias("merged"), F.array_join(cleaned, ",").alias("cleaned"))


@_query("""WITH s AS (SELECT DISTINCT row_index, reference_images AS c FROM samples), l AS (SELECT row_index, CASE WHEN json_valid(c) AND json_type(c) = 'ARRAY' THEN list_filter(list_transform(from_json(c, '["varchar"]'), lambda x: trim(x, ' ')), lambda x: x IS NOT NULL AND x <> '') ELSE [] END AS v FROM s)
    SELECT row_index, len(v) AS n, v[1] AS first_value FROM l""")
def sample_string_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are JSON arrays of strings; any other cell gives none."""
    v = jsonops.string_array(F.col("reference_images"))
    return _samples(spark, sf_dir).select("row_index", F.size(v).cast("bigint").alias("n"), F.try_element_at(v, F.lit(1)).alias("first_value"))


@_query(f"""WITH {_EVENTS} SELECT event_id, CASE WHEN (k % 4 <> 0 AND value <= 20) OR event_type IN ('error') OR value < 5 THEN 'failed' WHEN (k % 4 <> 0 AND value > 20) THEN 'ok' ELSE 'unknown' END AS state,
    CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 11 = 0 THEN 'homophone' WHEN (k % 50) / 5.0 - value / 10 > 0.7 THEN 'expected_preferred' WHEN (k % 50) / 5.0 - value / 10 < -0.7 THEN 'observed_preferred' ELSE 'ambiguous' END AS reading,
    CASE WHEN k % 7 <> 0 THEN CAST(round(log10(exp(least(50.0, greatest(-50.0, (k % 50) / 5.0 - value / 10)))) * 1000) AS BIGINT) END AS log_ratio,
    CASE WHEN event_type = 'error' THEN 'tool' WHEN value < 10 THEN 'weak' WHEN k > 90 THEN 'late' END AS veto_stage FROM e""")
def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a run that may be unknown, which of two readings its scores prefer, and the first veto."""
    e = _events(spark, sf_dir)
    success = F.when(F.col("k") % 4 != 0, F.col("value") > 20)
    error = F.when(F.col("value") < 5, "low")
    observed, expected = F.when(F.col("k") % 7 != 0, F.col("value") / 10), (F.col("k") % 50) / F.lit(5.0)
    out = rules.cascade(e, [("tool", F.col("event_type") == "error"), ("weak", F.col("value") < 10), ("late", F.col("k") > 90)])
    return out.select(
        "event_id", validation.run_state(success, F.col("event_type"), error).alias("state"), dialogue.likelihood_decision(observed, expected, F.col("k") % 11 == 0).alias("reading"),
        F.round(F.log10(dialogue.likelihood_ratio(observed, expected)) * 1000).cast("bigint").alias("log_ratio"), "veto_stage",
    )


@_query("""WITH s AS (SELECT DISTINCT seg_id, confidence, words FROM speech_segments)
    SELECT seg_id, len(list_filter(words, lambda w: w.text IS NOT NULL)) * CASE WHEN confidence = 'high' THEN 1 ELSE 0 END AS shown FROM s WHERE words IS NOT NULL""")
def speech_masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of rows that are not of high confidence lose their text."""
    s = table(spark, sf_dir, "speech_segments").dropDuplicates(["seg_id"]).where("words IS NOT NULL")
    masked = validation.mask_nested(F.col("words"), "text", F.col("confidence") == "high")
    return s.select("seg_id", F.size(F.filter(masked, lambda w: w["text"].isNotNull())).cast("bigint").alias("shown"))


@_query("""WITH t AS (SELECT doc_id, text, instr(text, '，') AS at, list_filter(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+'), lambda w: w NOT IN ('the', 'a', 'and')) AS l FROM documents), w AS (SELECT *, list_distinct(l) AS d FROM t)
    SELECT doc_id, length(regexp_replace(text, '[^\\x{3400}-\\x{9fff}]', '', 'g')) >= 4 OR (len(d) >= 3 AND coalesce(list_sum(list_transform(d, lambda x: length(x))), 0) >= 8) AS substantial,
      length(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g')) AS caption_letters FROM w""")
def doc_speech_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text says anything, and its letters as a caption has them."""
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", textops.is_substantial_speech(t, ["the", "a", "and"]).alias("substantial"), F.length(textops.caption_characters(t)).alias("caption_letters"))


@_query("""WITH t AS (SELECT doc_id, text, right(text, 900) AS tail, instr(text, ':') AS colon FROM documents), r AS (SELECT *, regexp_extract_all(tail, '\\d+(?:\\.\\d+)?\\s*(?:s|秒)?\\s*[-–—~至到]\\s*\\d+(?:\\.\\d+)?\\s*(?:s|秒)') AS l FROM t)
    SELECT doc_id, TRY_CAST(regexp_extract(l[-1], '(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*[-–—~至到]\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS start_sec, TRY_CAST(regexp_extract(l[-1], '(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*[-–—~至到]\\s*(\\d+(?:\\.\\d+)?)', 2) AS DOUBLE) AS end_sec,
      CASE WHEN colon > 0 THEN trim(regexp_extract(substr(text, 1, colon - 1), '([^。；;！!？?\\n]*)$', 1) || ':' || regexp_extract(substr(text, colon + 1), '^([^。；;！!？?\\n]*)', 1), ' ') END AS clause FROM r""")
def doc_last_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last time range near the end of each text, and the clause around its first colon."""
    t = F.col("text")
    r = textops.last_time_range(t)
    at = F.instr(t, ":")
    return _documents(spark, sf_dir).select("doc_id", r["start_sec"].alias("start_sec"), r["end_sec"].alias("end_sec"), F.when(at > 0, textops.clause_at(t, at - 1, at)).alias("clause"))


# ---- geometry, plans and stages --------------------------------------------------------------------------------------
@_query(f"""WITH RECURSIVE {_ISSUES}, i AS (SELECT pos, record_kind, keyframe_sec, {_SEC('time_range', 1)} AS a, {_SEC('time_range', 2)} AS b, {_NUM('bbox', 1)} AS x1, {_NUM('bbox', 2)} AS y1, {_NUM('bbox', 3)} AS x2, {_NUM('bbox', 4)} AS y2 FROM fields),
    k AS (SELECT pos, record_kind, TRY_CAST(keyframe_sec AS DOUBLE) AS frame, CASE WHEN b > a THEN a END AS a, CASE WHEN b > a THEN b END AS b, x1, y1, x2, y2 FROM i)
    SELECT record_kind, pos, frame, printf('%.2fs - %.2fs', a, b) AS shown, CASE WHEN a IS NULL THEN true ELSE least(b, 12.0) >= greatest(a, 8.0) END AS touches, CASE WHEN a IS NULL THEN false ELSE least(b, 12.0) > greatest(a, 8.0) END AS overlaps,
      coalesce(x1 * 1280 / 1280 >= 0 AND y1 >= 0 AND x2 > x1 AND y2 > y1 AND x2 <= 1 AND y2 <= 1, false) AS boxed FROM k""")
def issue_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of issues printed and compared with a stretch by both rules, and their boxes from any scale."""
    i = _issues(spark, sf_dir)
    r = geometry.time_range(F.col("time_range"), False)
    corner = [F.regexp_extract("bbox", r"([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)", g).try_cast("double") for g in range(1, 5)]
    hit = lambda closed: overlaps(r["start_sec"], r["end_sec"], F.lit(8.0), F.lit(12.0), closed, closed)
    return i.select("record_kind", "pos", geometry.finite(F.col("keyframe_sec")).alias("frame"), F.when(r.isNotNull(), geometry.format_range(r["start_sec"], r["end_sec"])).alias("shown"), hit(True).alias("touches"), hit(False).alias("overlaps"), geometry.scaled_box(*corner, F.lit(1280), F.lit(720)).isNotNull().alias("boxed"))


_CLIPS = "c AS (SELECT sample_id, max(end_sec) AS duration FROM speech_segments WHERE sample_id IS NOT NULL GROUP BY sample_id)"


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speech_segments").where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.max("end_sec").alias("duration"))


@_query(f"""WITH {_CLIPS}, n AS (SELECT sample_id, greatest(1, CAST(ceil(duration * 0.5) AS INT)) AS n FROM c WHERE duration > 0), f AS (SELECT sample_id, n, unnest(generate_series(0, least(n, 8) - 1)) AS frame FROM n)
    SELECT sample_id, CAST(frame AS INT) AS frame, floor(frame * greatest(1.0, n / 8)) / 0.5 AS at_sec FROM f""")
def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of each clip to look at: one in two seconds, at most eight."""
    return sampling.frame_plan(_clips(spark, sf_dir), "sample_id", "duration", 0.5, 8)


@_query(f"""WITH {_CLIPS}, r AS (SELECT sample_id, least(greatest(2.0, 0.0), duration) AS a, duration FROM c WHERE duration IS NOT NULL), b AS (SELECT *, least(greatest(30.0, a), duration) AS b FROM r),
    n AS (SELECT *, least(48, greatest(1, CAST(ceil((b - a) * 2.0) AS INT))) AS n FROM b), k AS (SELECT *, CAST(ceil(sqrt(n)) AS INT) AS cols FROM n)
    SELECT sample_id, a AS start_sec, b AS end_sec, CAST(n AS INT) AS frames, cols AS columns_, CAST(ceil(n / cols) AS INT) AS rows_, CAST(floor((row_number() OVER (ORDER BY sample_id) - 1) / 100) AS INT) >= 0 AS batched FROM k""")
def clip_contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact sheets of the stretch from 2 to 30 seconds of each clip."""
    r = sampling.contact_range(F.lit(2.0), F.lit(30.0), F.col("duration"), 2.0)
    c = _clips(spark, sf_dir).where("duration IS NOT NULL").select("sample_id", r.alias("r"))
    return c.select("sample_id", "r.start_sec", "r.end_sec", "r.frames", F.col("r.columns").alias("columns_"), F.col("r.rows").alias("rows_"), (sampling.batch_of(F.lit(1), 100) >= 0).alias("batched"))


@_query("SELECT r AS fps, b AS budget, CAST(ceil(30.0 * r) AS INT) AS frames, ceil(30.0 * r) <= b AS fits FROM (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS r) CROSS JOIN (SELECT unnest([8, 16, 32, 48, 60, 80]) AS b)")
def capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a 30 second clip at each rate against each budget."""
    return sampling.capacity_matrix(spark, 30.0, [0.5, 1.0, 2.0], [8, 16, 32, 48, 60, 80])


@_query(f"""WITH {_EVENTS}, m AS (SELECT user_id AS video, CAST(round_even(avg(k % 31 - 15), 0) AS INT) AS "offset", avg(value / 10) AS c, avg(k / 10.0) AS d FROM e GROUP BY user_id)
    SELECT video, "offset", CAST(round(c * 10000) AS BIGINT) AS confidence, CAST(round(d * 10000) AS BIGINT) AS min_dist, CASE WHEN c >= 7 THEN 'excellent' WHEN c >= 5 THEN 'good' WHEN c >= 3 THEN 'fair' ELSE 'poor' END AS quality FROM m""")
def event_sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synchronisation of each user's tracks as one measure and band."""
    tracks = _events(spark, sf_dir).select(F.col("user_id").alias("video"), (F.col("k") % 31 - 15).alias("offset_frames"), (F.col("value") / 10).alias("confidence"), (F.col("k") / F.lit(10.0)).alias("min_dist"))
    return sampling.sync_summary(tracks, "video").select("video", "offset", *[F.round(F.col(c) * 10000).cast("bigint").alias(c) for c in ("confidence", "min_dist")], "quality")


@_query("""WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
    SELECT left_id, right_id, CASE WHEN c >= 0.55 THEN 'same' WHEN c <= 0.30 THEN 'different' ELSE 'ambiguous' END AS decision FROM p WHERE c >= 0.25""")
def embedding_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether like vectors are of one source: same, different or ambiguous."""
    return vectors.all_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.25).select("left_id", "right_id", vectors.pair_decision(F.col("cosine")).alias("decision"))


@_query("""SELECT * FROM (VALUES (1, 'asr', 'asr:' || sha256('{}'), 'preloaded', '{}', 'ok', NULL), (2, 'asr', 'asr:' || sha256('{}'), 'hit', '{}', 'ok', NULL), (3, 'count', 'count:' || sha256('{"kind":"click"}'), 'miss', '{"kind": "click"}', 'ok', NULL),
    (4, 'count', 'count:' || sha256('{"kind":"click"}'), 'hit', '{"kind": "click"}', 'ok', NULL), (5, 'broken', 'broken:' || sha256('{}'), 'miss', '{}', 'failed', 'ValueError: no model'), (6, 'broken', 'broken:' || sha256('{}'), 'hit', '{}', 'failed', 'ValueError: no model'))
    t(sequence, stage, cache_key, cache_status, parameters, status, error)""")
def stage_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages run once, are kept by their parameters, and fail without ending the plan: the trace of such a run."""
    stages = Stages()

    def broken() -> DataFrame:
        raise ValueError("no model")

    stages.register("count", lambda kind: _events(spark, sf_dir).where(F.col("event_type") == kind).groupBy().count())
    stages.register("broken", broken)
    stages.preload("asr", table(spark, sf_dir, "speech_segments"))
    stages.run("asr")
    for _ in range(2):
        stages.run("count", kind="click")
    for _ in range(2):
        stages.run("broken")
    return stages.trace(spark)


# ---- runs ------------------------------------------------------------------------------------------------------------
@_query("""WITH m AS (SELECT unnest(['small', 'large']) AS model, unnest([0, 1]) AS i), p AS (SELECT unnest(['baseline', 'dense', 'cropped']) AS profile, unnest([0, 1, 2]) AS j), n AS (SELECT unnest(['8', '16']) AS images, unnest([0, 1]) AS k)
    SELECT CAST(1 + i * 6 + j * 2 + k AS INT) AS run, model, profile, images, 'run --model ' || model || ' --profile ' || profile || ' --images ' || images AS command FROM m, p, n""")
def run_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model with every profile and number of images, as numbered commands."""
    dims = {"model": ["small", "large"], "profile": [p[0] for p in drivers.PROFILES], "images": ["8", "16"]}
    return drivers.run_matrix(spark, dims, "run --model {model} --profile {profile} --images {images}")


@_query("SELECT * FROM (VALUES ('baseline', 1.0::DOUBLE, 32, 'none', 'none'), ('dense', 2.0, 60, 'none', 'audio'), ('cropped', 2.0, 60, 'role', 'audio')) t(profile, fps, frames, crop, audio)")
def run_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.profiles(spark)


@_query("""WITH c AS (SELECT DISTINCT user_id FROM events UNION SELECT -1), l AS (SELECT user_id, arg_max(event_type, event_id) AS last_record, count(*) AS lines FROM events GROUP BY user_id)
    SELECT user_id, user_id % 3 AS exit_code, last_record, coalesce(lines, 0) AS lines, user_id % 3 <> 0 AS failed FROM c LEFT JOIN l USING (user_id)""")
def run_last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of each run with the last line of its log; one run has no log."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    exits = e.select("user_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"))).withColumn("exit_code", F.col("user_id") % 3)
    return drivers.run_outcomes(exits, e, "user_id", "event_id", "event_type")


@_query(f"""WITH {_EVENTS}, a AS (SELECT event_id, CASE WHEN value < 5 THEN 'low' END AS ea, CASE WHEN event_type = 'error' THEN 'tool' END AS eb, k, value FROM e)
    SELECT event_id, CASE WHEN ea IS NULL THEN CAST(floor(value) AS BIGINT) END AS read_value, CASE WHEN ea IS NULL THEN 'ok' ELSE 'failed' END AS read_status, ea AS read_error, CASE WHEN ea IS NULL AND eb IS NULL THEN k END AS check_value,
      CASE WHEN ea IS NOT NULL THEN 'skipped' WHEN eb IS NULL THEN 'ok' ELSE 'failed' END AS check_status, CASE WHEN ea IS NULL THEN eb END AS check_error, CASE WHEN ea IS NOT NULL THEN 'read' WHEN eb IS NOT NULL THEN 'check' END AS failed_stage FROM a""")
def run_staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over every row, with the error of a row beside it and nothing behind a failed stage."""
    stages = [("read", F.floor("value"), F.when(F.col("value") < 5, "low")), ("check", F.col("k"), F.when(F.col("event_type") == "error", "tool"))]
    return drivers.staged(_events(spark, sf_dir), stages).select("event_id", *[f"{s}_{c}" for s in ("read", "check") for c in ("value", "status", "error")], "failed_stage")


@_query("""WITH l AS (SELECT doc_id, arg_max(offensive IS NOT NULL, (reviewed_at, reviewer)) AS ok FROM review_labels GROUP BY doc_id)
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE ok)""")
def run_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose last review did not end well, or that have none: what a resumed run still has to do."""
    log = table(spark, sf_dir, "review_labels").select("doc_id", F.struct("reviewed_at", "reviewer").alias("position"), F.when(F.col("offensive").isNotNull(), "ok").otherwise("failed").alias("status"))
    return drivers.remaining(_documents(spark, sf_dir).select("doc_id"), log, "doc_id")


@_query("""WITH s AS (SELECT DISTINCT row_index, video AS v FROM samples), p AS (SELECT row_index, v, 'http://x/' || v AS u, '../' || v AS up, '/data/./gen' || v AS inside FROM s)
    SELECT row_index, CASE WHEN starts_with(v, '/data/') AND v NOT LIKE '%..%' THEN v END AS path, CASE WHEN coalesce(trim(v, ' '), '') = '' THEN 'empty' WHEN NOT starts_with(v, '/data/') THEN 'outside' END AS error, CASE WHEN v IS NULL THEN 'empty' ELSE 'url' END AS url_error,
      CASE WHEN v IS NULL THEN 'empty' WHEN starts_with(v, '/data/') THEN NULL ELSE 'outside' END AS up_error, '/data/gen' || rtrim(v, '/') AS inside FROM p""")
def run_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media paths under one root: as they are, as a URL, one step up, and with a step that stays."""
    v = F.col("video")
    at = {n: drivers.path_under(c, "/data") for n, c in {"own": v, "url": F.concat(F.lit("http://x/"), v), "up": F.concat(F.lit("../"), v.substr(F.lit(2), F.length(v))), "inside": F.concat(F.lit("/data/./gen"), v)}.items()}
    return _samples(spark, sf_dir).select("row_index", at["own"]["path"].alias("path"), at["own"]["error"].alias("error"), at["url"]["error"].alias("url_error"), at["up"]["error"].alias("up_error"), at["inside"]["path"].alias("inside"))


@_query("""WITH s AS (SELECT DISTINCT seg_id, words, text FROM speech_segments), l AS (SELECT seg_id, list_filter(list_transform(words, lambda w: w.text), lambda t: t IS NOT NULL) AS w, CASE WHEN text IS NOT NULL THEN [text] END AS t FROM s)
    SELECT seg_id, CASE WHEN len(w) > 0 THEN len(w) WHEN t IS NOT NULL THEN 1 ELSE 0 END AS parts, CASE WHEN len(w) > 0 THEN w[1] ELSE t[1] END AS first_part FROM l""")
def segment_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a segment consists of: its words, else its text, else nothing."""
    s = table(spark, sf_dir, "speech_segments").dropDuplicates(["seg_id"])
    words = F.filter(F.transform("words", lambda w: w["text"]), lambda t: t.isNotNull())
    parts = drivers.first_available(words, F.when(F.col("text").isNotNull(), F.array("text")))
    return s.select("seg_id", F.size(parts).cast("bigint").alias("parts"), F.try_element_at(parts, F.lit(1)).alias("first_part"))


@_query("""WITH s AS (SELECT DISTINCT row_index, sample_id FROM samples), p AS (SELECT row_index, prediction_source AS src, count(DISTINCT pred_id) AS n FROM predictions GROUP BY ALL)
    SELECT s.row_index, '{"sample_id":"' || coalesce(sample_id, '') || '","predictions":[' || (SELECT string_agg('{"source":"' || t || '","prediction":"' || coalesce(CAST(n AS VARCHAR), '[]') || '"}', ',' ORDER BY t) FROM (SELECT unnest(['A', 'B', 'C']) AS t) x LEFT JOIN p ON p.row_index = s.row_index AND p.src = x.t) || ']}' AS payload FROM s""")
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer gets of each sample: its fields and its sources in fixed order (here how many predictions each gave)."""
    n = _predictions(spark, sf_dir).groupBy("row_index").agg(*[F.nullif(F.count_if(F.col("prediction_source") == x), F.lit(0)).cast("string").alias(x) for x in "ABC"])
    rows = _samples(spark, sf_dir).select("row_index", "sample_id").join(n, "row_index", "left")
    return rows.select("row_index", drivers.review_payload({"sample_id": F.col("sample_id")}, {x: F.col(x) for x in "ABC"}).alias("payload"))


@_query("""WITH v AS (SELECT doc_id, arg_min(CASE WHEN offensive = 1 THEN 'supported' WHEN offensive = 0 THEN 'contradicted' ELSE 'unsure' END, (reviewed_at, reviewer)) AS verdict FROM review_labels GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_kind = 'prompt' THEN 'settled' WHEN lang IS NULL THEN 'not_verified' WHEN verdict IN ('supported', 'contradicted') THEN verdict ELSE 'inconclusive' END AS outcome FROM documents LEFT JOIN v USING (doc_id)""")
def label_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts are settled; other documents stay by their verdict, and are abstained from where none was to be had."""
    d = _documents(spark, sf_dir).select("doc_id", "doc_kind", "lang")
    out = mediachecks.gated_by_verdicts(d.where("doc_kind <> 'prompt'"), d.where("doc_kind = 'prompt'"), _verdicts(spark, sf_dir), "doc_id", F.col("lang").isNotNull())
    return out.select("doc_id", "outcome")


@_query()
def document_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that texts give to roles, each checked against the place it is said to stand at."""
    d = _documents(spark, sf_dir).select("doc_id", "text", roles.cast_plan(F.col("text")).alias("plan"))
    turns = d.select("doc_id", "text", "plan.scope", F.explode("plan.turns").alias("t"))
    return turns.select("doc_id", "scope", "t.turn", "t.role", "t.rule", "t.dialogue", "t.start_sec", "t.end_sec", roles.stands_there(F.col("text"), F.col("t")).alias("valid"))


@_query()
def prompt_media_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that prompts and feedback state, against the length of the clip's speech; sizes are not measured here."""
    clips = _clips(spark, sf_dir)
    s = _samples(spark, sf_dir).select("row_index", "sample_id", "prompt", "feedback").join(clips, "sample_id", "left")
    none = F.lit(None).cast("int")
    return mediachecks.check_constraints(s, "row_index", {"prompt": F.col("prompt"), "feedback": F.col("feedback")}, none, none, F.col("duration"))


@_query()
def speech_prompt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where speech stands in the prompt of its clip, and what was said otherwise."""
    seg = table(spark, sf_dir, "speech_segments").where("sample_id IS NOT NULL").dropDuplicates(["seg_id"])
    prompts = contracts.first_wins(_samples(spark, sf_dir).where("sample_id IS NOT NULL AND prompt IS NOT NULL").select("sample_id", "prompt", "row_index"), ["sample_id"], "row_index")
    return dialogue.prompt_candidates(seg, prompts, "sample_id", "seg_id").drop("differences")
