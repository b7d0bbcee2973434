"""Queries over documents, labels, samples and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import textops
from tessera.functions.geometry import bbox_bounds, duration_within, time_range
from tessera.functions.jsonops import cache_key, fingerprint, is_object_array, json_kind
from tessera.operators import contracts, crosstabs, dialogue
from tessera.operators.greedy import keep_uncovered
from tessera.operators.matching import repair_coverage
from tessera.operators.nested import nested_tables, subtype_table
from tessera.plans import rules
from tessera.queries import nested_sql
from tessera.runtime import table

KINDS = ["prompt", "feedback", "transcript", "subtitle_dump", "issue_report", "gold_note", "run_log"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each document."""
    ranked = table(spark, sf_dir, "review_labels").withColumn("order", F.struct("reviewed_at", "reviewer"))
    return contracts.last_wins(ranked, "doc_id", "order").select("doc_id", "offensive", "reviewer")


def doc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(t.isNull()).alias("null_text"), F.count_if(F.trim(t) == "").alias("blank_text"),
        F.count_if(F.length(t) != F.col("n_chars")).alias("stale_length"), F.count_if(F.col("sample_id").isNull()).alias("no_sample"), F.sum(F.length(t)).alias("characters"),
    )


_ROUTES = (
    ("clock", r"[0-9]{1,2}:[0-9]{2}"), ("fence", "```"), ("json", r"\{\s*\""), ("tag", r"<\|"), ("quote", "[“”]"), ("list", r"(?m)^- \["),
)


def doc_route_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route whose pattern a text holds, in order."""
    labels = rules.all_matches([(name, F.col("text").rlike(p)) for name, p in _ROUTES])
    return _docs(spark, sf_dir).select("doc_id", F.array_join(labels, ",").alias("routes"))


def doc_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = doc_route_multilabel(spark, sf_dir).where("routes <> ''").select(F.explode(F.split("routes", ",")).alias("route"))
    return crosstabs.counts_with_zeros(r, "route", [name for name, _ in _ROUTES] + ["none"])


def _first_rule():
    return rules.first_match([(name, F.col("text").rlike(p)) for name, p in _ROUTES], "other")


def doc_first_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first rule that holds, over the whole domain."""
    return rules.partition_counts(_docs(spark, sf_dir), _first_rule(), [name for name, _ in _ROUTES] + ["other", "never"])


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple predicate against the last labels, by kind: tp, fp, fn and rates."""
    joined = _docs(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id")
    return crosstabs.precision_recall(joined, F.col("text").rlike("[“”]"), F.col("offensive") == 1, ["doc_kind"])


def doc_source_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstabs.crosstab(_docs(spark, sf_dir), "source", "doc_kind", KINDS)


def doc_manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their last label; those without take defaults."""
    out = contracts.complete_left_join(_docs(spark, sf_dir).select("doc_id", "doc_kind"), _labels(spark, sf_dir), "doc_id", {"offensive": -1, "reviewer": "none"})
    return out.select("doc_id", "doc_kind", "offensive", "reviewer", "found")


def label_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.key_violations(table(spark, sf_dir, "review_labels"), "doc_id")


def label_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels without a document."""
    return contracts.orphans(_docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "review_labels").select("doc_id"), "doc_id")


def sample_prediction_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_index, sample_id) pairs that samples and predictions do not share."""
    cols = ["row_index", "sample_id"]
    return contracts.set_difference(table(spark, sf_dir, "samples").select(*cols).distinct(), table(spark, sf_dir, "predictions").select(*cols).distinct())


def sample_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference input without gold and feedback."""
    return contracts.allow_list(table(spark, sf_dir, "samples").drop("logged_at").distinct(), ["row_index", "prompt", "video"], "sample_id", "row_index")


def sample_select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "samples").select("row_index").distinct()
    return contracts.select_rows(rows, "row_index", 11, 40)


def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    hashed = _docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("\u0000")), 256).alias("hash"))
    return contracts.first_wins(hashed, ["hash"], "doc_id").select("doc_id")


def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short fact ids with a domain, and cache keys."""
    cols = {"kind": F.col("doc_kind"), "lang": F.coalesce("lang", F.lit("-"))}
    return _docs(spark, sf_dir).select("doc_id", fingerprint(cols, F.col("source"), 16).alias("fact_id"), cache_key(F.lit("probe"), cols).alias("cache_key"))


def doc_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.length(textops.compact_text(t)).alias("compact"), F.length(textops.without_blanks(t)).alias("unblanked"), textops.language_family(t).alias("family"),
        F.size(textops.surface_tokens(t)).alias("tokens"), F.size(textops.number_tokens(t)).alias("numbers"), F.size(textops.quoted_spans(t)).alias("quotes"),
        F.array_join(textops.event_tags(t), ",").alias("tags"), textops.contains_any(t, ["灯笼", "lantern", "(take two)"]).alias("marked"),
    )


def doc_canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(textops.number_tokens(F.col("text")))).alias("raw"))
    return found.select("doc_id", "raw", textops.canonical_number(F.col("raw")).alias("number"))


def doc_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded texts and where their characters came from."""
    d = _docs(spark, sf_dir).select("doc_id", textops.fold_text(F.col("text")).alias("folded"), textops.folded_with_offsets(F.col("text")).alias("o"))
    return d.select("doc_id", "folded", F.length("o.text").alias("kept"), F.try_element_at("o.offsets", F.lit(-1)).alias("last_offset"))


def prediction_json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "predictions").select("pred_id", "prediction").distinct()
    return p.groupBy(json_kind(F.col("prediction")).alias("kind"), is_object_array(F.col("prediction")).alias("object_array")).agg(F.count(F.lit(1)).alias("predictions"))


def sample_fenced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "samples").select("row_index", "gold").distinct()
    return s.select("row_index", F.size(textops.fenced_blocks(F.col("gold"))).alias("blocks"), F.length(F.try_element_at(textops.fenced_blocks(F.col("gold")), F.lit(-1))).alias("last_length"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each prediction, however it is wrapped and whatever language its keys have."""
    nested = nested_tables(table(spark, sf_dir, "predictions").select("pred_id", "prediction"), "prediction", "pred_id", "prediction").dropDuplicates(["record_id"])
    return subtype_table(nested, "issue")


def issue_time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated time ranges: which parse, and whether they have a length."""
    raw = _issues(spark, sf_dir).where("time_range IS NOT NULL").groupBy(F.col("time_range").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    a, b = time_range(F.col("raw"), True), time_range(F.col("raw"), False)
    return raw.select("raw", "n", a["start_sec"].alias("start_sec"), a["end_sec"].alias("end_sec"), b.isNotNull().alias("has_length"), duration_within(a["end_sec"] - a["start_sec"], F.lit(3.0), F.lit("exact")).alias("about_three"))


def issue_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated boxes: which are valid, and their area."""
    raw = _issues(spark, sf_dir).select(F.explode(F.regexp_extract_all("bbox", F.lit("<bbox>([^<]*)</bbox>"), F.lit(1))).alias("raw"))
    box = bbox_bounds(F.col("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", "n", box.isNotNull().alias("valid"), F.round((box["x2"] - box["x1"]) * (box["y2"] - box["y1"]) * 10000).cast("int").alias("area"))


def issue_semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a prediction that no earlier issue of the same type covers."""
    rows = _issues(spark, sf_dir).select("record_id", F.col("issue_pos").alias("pos"), "issue_type", "description")
    return keep_uncovered(rows, ["record_id", "issue_type"], "description").select("record_id", "pos")


def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources claim kinds: the rows that stay and the facts nobody claims."""
    d = _docs(spark, sf_dir).where(F.col("sample_id").isNotNull())
    claims = d.select("sample_id", F.col("doc_id").alias("pos"), F.array("doc_kind").alias("fact_ids"))
    facts = d.select("sample_id").distinct().select("sample_id", F.explode(F.array(*[F.lit(k) for k in KINDS[:3]])).alias("fact_id"))
    keep, missing = repair_coverage(claims, facts, "sample_id")
    return keep.select("sample_id", F.lit("keep").alias("what"), F.col("pos").cast("string").alias("item")).unionByName(missing.select("sample_id", F.lit("append").alias("what"), F.col("fact_id").alias("item")))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "samples").select("row_index", "sample_id", "prompt").distinct()


def prompt_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is to say what in each prompt."""
    d = _prompts(spark, sf_dir).select("row_index", dialogue.speech_plan(F.col("prompt")).alias("p"))
    return d.select("row_index", "p.scope", F.explode_outer("p.turns").alias("t")).select("row_index", "scope", "t.turn", "t.role", "t.dialogue", "t.start", "t.end")


def prompt_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.media_constraints(_prompts(spark, sf_dir), "row_index", "prompt")


def prompt_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech that stands, nearly or exactly, in the prompt of its clip."""
    seg = table(spark, sf_dir, "speech_segments").where("sample_id IS NOT NULL").select("sample_id", "seg_id", "text").distinct()
    prompts = contracts.first_wins(_prompts(spark, sf_dir).where("sample_id IS NOT NULL"), ["sample_id"], "row_index")
    return dialogue.anchors(seg, prompts.select("sample_id", "prompt"), "sample_id", "seg_id")


QUERIES = {
    f.__name__: f
    for f in (
        doc_audit, doc_route_multilabel, doc_route_summary, doc_first_rule_counts, label_confusion, doc_source_crosstab, doc_manifest_join, label_key_violations, label_orphans,
        sample_prediction_difference, sample_allow_list, sample_select_rows, doc_exact_dedup, doc_fingerprint, doc_text_features, doc_canonical_numbers, doc_folded,
        prediction_json_kinds, sample_fenced_blocks, issue_time_ranges, issue_boxes, issue_semantic_dedup, fact_coverage,
        prompt_dialogues, prompt_constraints, prompt_anchors,
    )
}

_LAST = "last AS (SELECT doc_id, arg_max(offensive_s, (reviewed_at, reviewer)).o AS offensive, arg_max(reviewer, (reviewed_at, reviewer)) AS reviewer FROM (SELECT *, {'o': offensive} AS offensive_s FROM review_labels) GROUP BY doc_id)"
_R = {"clock": "[0-9]{1,2}:[0-9]{2}", "fence": "```", "json": '\\{\\s*"', "tag": "<\\|", "quote": "[“”]", "list": "(?m)^- \\["}
_HITS = ", ".join(f"regexp_matches(text, '{p}') AS r_{n}" for n, p in _R.items())
_ROUTE_SQL = f"h AS (SELECT *, {_HITS} FROM documents), routed AS (SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN r_{n} THEN {chr(39)}{n}{chr(39)} END' for n in _R)}], lambda x: x IS NOT NULL), ',') AS routes FROM h)"

ORACLE = {
    "doc_audit": """SELECT count(*) AS documents, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (trim(text, ' ') = '') AS blank_text, count(*) FILTER (length(text) <> n_chars) AS stale_length,
        count(*) FILTER (sample_id IS NULL) AS no_sample, sum(length(text)) AS characters FROM documents""",
    "doc_route_multilabel": f"WITH {_ROUTE_SQL} SELECT * FROM routed",
    "doc_route_summary": f"""WITH {_ROUTE_SQL}, x AS (SELECT unnest(string_split(routes, ',')) AS route FROM routed), d AS (SELECT unnest([{', '.join(repr(n) for n in _R)}, 'none']) AS route)
        SELECT d.route, count(x.route) AS n FROM d LEFT JOIN x ON d.route = x.route GROUP BY d.route""",
    "doc_first_rule_counts": f"""WITH {_ROUTE_SQL}, f AS (SELECT CASE WHEN routes = '' OR routes IS NULL THEN 'other' ELSE split_part(routes, ',', 1) END AS label FROM routed), d AS (SELECT unnest([{', '.join(repr(n) for n in _R)}, 'other', 'never']) AS label)
        SELECT d.label, count(f.label) AS n FROM d LEFT JOIN f ON d.label = f.label GROUP BY d.label""",
    "label_confusion": f"""WITH {_LAST}, j AS (SELECT doc_kind, regexp_matches(text, '[“”]') AS p, offensive = 1 AS a FROM documents JOIN last USING (doc_id)),
        c AS (SELECT doc_kind, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM j GROUP BY doc_kind)
        SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c""",
    "doc_source_crosstab": f"SELECT source, {', '.join(f'count(*) FILTER (doc_kind = {chr(39)}{k}{chr(39)}) AS c_{k}' for k in KINDS)} FROM documents GROUP BY source",
    "doc_manifest_join": f"WITH {_LAST} SELECT doc_id, doc_kind, coalesce(offensive, -1) AS offensive, coalesce(last.reviewer, 'none') AS reviewer, last.doc_id IS NOT NULL AS found FROM documents LEFT JOIN last USING (doc_id)",
    "label_key_violations": "SELECT 'duplicate' AS reason, CAST(doc_id AS VARCHAR) AS key, count(*) AS n FROM review_labels GROUP BY doc_id HAVING count(*) > 1",
    "label_orphans": """WITH d AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM review_labels)
        SELECT 'left' AS side, doc_id AS key FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT 'right', doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM d)""",
    "sample_prediction_difference": """WITH a AS (SELECT DISTINCT row_index, sample_id FROM samples), b AS (SELECT DISTINCT row_index, sample_id FROM predictions)
        SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "sample_allow_list": "SELECT DISTINCT CASE WHEN trim(sample_id, ' ') <> '' THEN sample_id ELSE '#' || row_index END AS sample_id, row_index, prompt, video FROM samples",
    "sample_select_rows": "SELECT DISTINCT row_index, row_index >= 11 AND row_index < 51 AS selected FROM samples",
    "doc_exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "doc_fingerprint": """WITH j AS (SELECT doc_id, source, '{"kind":"' || doc_kind || '","lang":"' || coalesce(lang, '-') || '"}' AS body FROM documents)
        SELECT doc_id, substr(sha256(encode(source) || '\\x00'::BLOB || encode(body)), 1, 16) AS fact_id, 'probe:' || sha256(body) AS cache_key FROM j""",
    "doc_text_features": """WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\x{3400}-\\x{9fff}]', '', 'g')) AS han, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS lat FROM documents)
        SELECT doc_id, length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')) AS compact, length(regexp_replace(text, '\\s+', '', 'g')) AS unblanked,
        CASE WHEN text IS NULL THEN NULL WHEN han >= 2 AND han >= lat THEN 'zh' WHEN lat >= 2 AND lat > han THEN 'latin' ELSE 'unknown' END AS family,
        len(regexp_extract_all(text, '[A-Za-z]+(?:[''’\\-][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*|\\S')) AS tokens, len(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?')) AS numbers,
        len(list_filter(list_distinct(list_transform(regexp_extract_all(text, '"[^"\\n]+"|“[^”\\n]+”|「[^」\\n]+」|『[^』\\n]+』'), lambda x: trim(substr(x, 2, length(x) - 2), ' '))), lambda x: x <> '')) AS quotes,
        CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string((SELECT list(g ORDER BY i) FROM (SELECT g, min(i) AS i FROM (SELECT unnest(regexp_extract_all(lower(text), '<\\|([^|<>]+)\\|>', 1)) AS g, generate_subscripts(regexp_extract_all(lower(text), '<\\|([^|<>]+)\\|>', 1), 1) AS i) GROUP BY g)), ','), '') END AS tags,
        contains(text, '灯笼') OR contains(text, 'lantern') OR contains(text, '(take two)') AS marked FROM t""",
    "doc_canonical_numbers": """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?')) AS raw FROM documents), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS x FROM t)
        SELECT doc_id, raw, CASE WHEN length(x) >= 4 AND NOT regexp_matches(x, '^0*$') THEN regexp_replace(x, '^0+', '') END AS number FROM d""",
    "prediction_json_kinds": f"""WITH p AS (SELECT DISTINCT pred_id, prediction AS t FROM predictions), k AS (SELECT pred_id, t, CASE WHEN {nested_sql.strict('t')} THEN CASE json_type(t) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind FROM p)
        SELECT kind, coalesce(kind = 'array' AND len(list_filter(from_json(CASE WHEN kind = 'array' THEN t END, '["json"]'), lambda x: json_type(x) IS DISTINCT FROM 'OBJECT')) = 0, false) AS object_array, count(*) AS predictions FROM k GROUP BY ALL""",
    "sample_fenced_blocks": """WITH s AS (SELECT DISTINCT row_index, gold FROM samples), b AS (SELECT row_index, gold, regexp_extract_all(gold, '(?is)```(?:json)?[ \\t]*\\r?\\n(.*?)```', 1) AS x FROM s)
        SELECT row_index, CASE WHEN gold IS NULL THEN NULL ELSE len(x) END AS blocks, length(x[-1]) AS last_length FROM b""",
    "issue_time_ranges": f"""{nested_sql.WITH}, r AS (SELECT {nested_sql.text_of('o', '时间区间', 'time_range')} AS raw FROM issue WHERE record_kind = 'prediction'), g AS (SELECT raw, count(*) AS n FROM r WHERE raw IS NOT NULL GROUP BY raw),
        v AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*[-–—~]\\s*(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*$', 1), '') AS DOUBLE) AS a, TRY_CAST(nullif(regexp_extract(raw, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*[-–—~]\\s*(\\d+(?:\\.\\d+)?)\\s*(?:s|秒)?\\s*$', 2), '') AS DOUBLE) AS b FROM g)
        SELECT raw, n, CASE WHEN b >= a THEN a END AS start_sec, CASE WHEN b >= a THEN b END AS end_sec, coalesce(b > a, false) AS has_length, CASE WHEN b >= a THEN abs(b - a - 3.0) <= 0.5 END AS about_three FROM v""",
    "issue_boxes": f"""{nested_sql.WITH}, r AS (SELECT unnest(regexp_extract_all({nested_sql.text_of('o', 'BBox', 'bbox')}, '<bbox>([^<]*)</bbox>', 1)) AS raw FROM issue WHERE record_kind = 'prediction'), g AS (SELECT raw, count(*) AS n FROM r GROUP BY raw),
        v AS (SELECT *, list_transform(string_split(raw, ','), lambda x: TRY_CAST(x AS DOUBLE)) AS c FROM g), k AS (SELECT *, coalesce(c[1] >= 0 AND c[2] >= 0 AND c[3] > c[1] AND c[4] > c[2] AND c[3] <= 1 AND c[4] <= 1, false) AS valid FROM v)
        SELECT raw, n, valid, CASE WHEN valid THEN CAST(round((c[3] - c[1]) * (c[4] - c[2]) * 10000) AS INT) END AS area FROM k""",
    "fact_coverage": """WITH d AS (SELECT sample_id, doc_id, doc_kind FROM documents WHERE sample_id IS NOT NULL), f AS (SELECT DISTINCT sample_id, unnest(['prompt', 'feedback', 'transcript']) AS k FROM d),
        first AS (SELECT sample_id, doc_kind, min(doc_id) AS doc_id FROM d GROUP BY ALL)
        SELECT sample_id, 'keep' AS what, CAST(doc_id AS VARCHAR) AS item FROM d WHERE doc_kind NOT IN ('prompt', 'feedback', 'transcript') OR doc_id IN (SELECT doc_id FROM first)
        UNION ALL SELECT sample_id, 'append', k FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.sample_id = f.sample_id AND d.doc_kind = f.k)""",
}
