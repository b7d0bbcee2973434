"""SQL of the nested records and of the rejected rows: the same results from SQL's own JSON and regular expressions."""

from __future__ import annotations

from tessera.operators.nested import SUBTYPES

#: DuckDB's parser lets a comma before a closing bracket, NaN and Infinity pass, strict JSON does not
def _bare(text: str) -> str:
    return rf"""regexp_replace({text}, '"(?:[^"\\]|\\.)*"', '""', 'g')"""


def _fences(text: str) -> str:
    return rf"regexp_extract_all({text}, '(?is)```(?:json)?[ \t]*\r?\n(.*?)```', 1)"


def strict(text: str) -> str:
    return f"(json_valid({text}) AND NOT regexp_matches({_bare(text)}, ',\\s*[\\]}}]|[nN]a[nN]|[iI]nf'))"


def _objects(value: str) -> str:
    """The objects of an array, of one object, or of a JSON string of either."""
    inner = f"({value}->>'$')"
    plain = "CASE json_type({0}) WHEN 'ARRAY' THEN list_filter(from_json({0}, '[\"json\"]'), lambda x: json_type(x) = 'OBJECT') WHEN 'OBJECT' THEN [{0}::JSON] ELSE []::JSON[] END"
    return f"CASE WHEN json_type({value}) = 'VARCHAR' THEN CASE WHEN {strict(inner)} THEN {plain.format(inner)} ELSE []::JSON[] END ELSE {plain.format(value)} END"


def _child(obj: str, *names: str) -> str:
    return "CASE " + " ".join(f"WHEN json_type({obj}, '{n}') <> 'NULL' THEN {obj}->'{n}'" for n in names) + " END"


def text_of(obj: str, *names: str) -> str:
    return "CASE " + " ".join(f"WHEN json_type({obj}, '{n}') <> 'NULL' THEN {obj}->>'{n}'" for n in names) + " END"


def _array_of_objects(text: str) -> str:
    return f"""coalesce(json_type({text}) = 'ARRAY' AND len(list_filter(from_json({text}, '["json"]'), lambda x: json_type(x) IS DISTINCT FROM 'OBJECT')) = 0, false)"""


def _gold(text: str) -> str:
    """The last block of a text that is an array of objects only."""
    return f"list_filter({_fences(text)}, lambda b: contains(b, '[') AND CASE WHEN {strict('b')} THEN {_array_of_objects('b')} ELSE false END)[-1]"


_EVIDENCE, _OBS, _ALT = ("证据", "evidence"), ("观测", "observations"), ("候选", "alternatives")
_BARE_TEXT = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"

#: issue, evidence, obs and alt: record_kind, record_id, the positions down to the level, and the object o
LEVELS = f"""
    said AS (SELECT DISTINCT pred_id AS id, prediction AS t FROM predictions WHERE prediction IS NOT NULL),
    text AS (
      SELECT id, t FROM said UNION ALL
      SELECT id, CASE WHEN {strict('t')} THEN t::JSON->>'$' ELSE {_fences(_BARE_TEXT)}[1] END FROM text
      WHERE CASE WHEN {strict('t')} THEN json_type(t) = 'VARCHAR' ELSE starts_with({_BARE_TEXT}, '```') AND ends_with({_BARE_TEXT}, '```') AND len({_fences(_BARE_TEXT)}) = 1 END),
    gold AS (SELECT DISTINCT row_index AS id, gold FROM samples WHERE gold IS NOT NULL),
    top AS (
      SELECT 'prediction' AS record_kind, id, CASE WHEN json_type(t) = 'OBJECT' AND json_exists(t, 'issues') THEN t::JSON->'issues' ELSE t::JSON END AS v
      FROM text WHERE CASE WHEN {strict('t')} THEN json_type(t) <> 'VARCHAR' ELSE false END
      UNION ALL SELECT 'gold', id, ({_gold('gold')})::JSON FROM gold),
    listed AS (SELECT record_kind, id, {_objects('v')} AS l FROM top),
    outer_ AS (SELECT record_kind, id AS record_id, unnest(l) AS o, generate_subscripts(l, 1)::INT AS issue_pos FROM listed),
    opened AS (SELECT *, CASE WHEN json_exists(o, 'issue') THEN ({_objects("(o->'issue')")})[1] END AS inner_o, ({_objects("(o->'provenance')")})[1] AS beside FROM outer_),
    issue AS (SELECT record_kind, record_id, issue_pos, coalesce(inner_o, o) AS o,
      CASE WHEN inner_o IS NULL THEN {_child('o', *_EVIDENCE)} ELSE coalesce({_child('inner_o', *_EVIDENCE)}, {_child('beside', *_EVIDENCE)}, {_child('o', *_EVIDENCE)}) END AS below FROM opened),
    l2 AS (SELECT *, {_objects('below')} AS l FROM issue),
    evidence AS (SELECT record_kind, record_id, issue_pos, unnest(l) AS o, generate_subscripts(l, 1)::INT AS evidence_pos FROM l2),
    l3 AS (SELECT *, {_objects('(' + _child('o', *_OBS) + ')')} AS l FROM evidence),
    obs AS (SELECT record_kind, record_id, issue_pos, evidence_pos, unnest(l) AS o, generate_subscripts(l, 1)::INT AS obs_pos FROM l3),
    l4 AS (SELECT *, {_objects('(' + _child('o', *_ALT) + ')')} AS l FROM obs),
    alt AS (SELECT record_kind, record_id, issue_pos, evidence_pos, obs_pos, unnest(l) AS o, generate_subscripts(l, 1)::INT AS alt_pos FROM l4)"""
WITH = f"WITH RECURSIVE {LEVELS}"

_RECORD = r'^(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*$'
_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^",\r\n]*)'
_NEEDS = ("可定位性", "置信度", "问题说明", "问题类型", "时间区间", "关键帧秒", "BBox")
_SPAN = "^([0-9]+(?:\\.[0-9]+)?)s - ([0-9]+(?:\\.[0-9]+)?)s$"


def _good_issue() -> str:
    text = lambda n: f"regexp_replace(x->>'{n}', '^\\s+|\\s+$', '', 'g')"
    span = text("时间区间")
    return (
        " AND ".join(f"coalesce(json_type(x, '{n}') = 'VARCHAR', false)" for n in _NEEDS)
        + f" AND {text('可定位性')} IN ('是', '否', '部分') AND {text('置信度')} IN ('高', '中', '低')"
        + f" AND ({span} = '' OR coalesce(CAST(nullif(regexp_extract({span}, '{_SPAN}', 1), '') AS DOUBLE) <= CAST(nullif(regexp_extract({span}, '{_SPAN}', 2), '') AS DOUBLE), false))"
    )


#: line_id, cells of well-formed records, and the first reason that holds
LINES = f"""
    raw AS (SELECT DISTINCT line_id, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^\\x{{feff}}', ''), '[\\r\\n]+$', '') AS r FROM prediction_lines),
    cut AS (SELECT line_id, r, regexp_full_match(r, '{_RECORD}') AS quoted,
      list_transform(regexp_extract_all(r, '{_CELL}', 1), lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) AS c FROM raw),
    cells AS (SELECT *, c[6] AS gold, c[7] AS prediction FROM cut),
    judged AS (SELECT *, CASE
      WHEN NOT quoted THEN 'quoting' WHEN len(c) <> 7 THEN 'column_count'
      WHEN regexp_matches(gold, '\\S') AND ({_gold('gold')}) IS NULL THEN 'gold'
      WHEN NOT regexp_matches(prediction, '\\S') THEN NULL
      WHEN NOT {strict('prediction')} THEN 'prediction'
      WHEN NOT {_array_of_objects('prediction')} THEN 'prediction'
      WHEN len(list_filter(from_json(prediction, '["json"]'), lambda x: NOT ({_good_issue()}))) > 0 THEN 'issue_value' END AS fail_reason FROM cells)"""

_DOWN = ("issue_pos", "evidence_pos", "obs_pos", "alt_pos")


def _key(depth: int) -> str:
    """The common key of the table at a depth: 0 below its own level."""
    return "record_kind, record_id, " + ", ".join(p if i <= depth else f"0 AS {p}" for i, p in enumerate(_DOWN))


def _parent(depth: int) -> str:
    return "concat_ws(':', record_kind, record_id, " + ", ".join(p if i < depth else "0" for i, p in enumerate(_DOWN)) + ") AS parent_key" if depth else "NULL::VARCHAR AS parent_key"


def _subtype(level: str) -> str:
    depth = ("issue", "evidence", "obs", "alt").index(level)
    typed = [f"TRY_CAST({text_of('o', *names)} AS DOUBLE) AS {c}" if t == "double" else f"{text_of('o', *names)} AS {c}" for c, (names, t) in SUBTYPES[level].items()]
    return f"{WITH} SELECT {_key(depth)}, {_parent(depth)}, {', '.join(typed)} FROM {level}"


_HEADS = ", ".join(f"c[{i}] AS {n}" for i, n in enumerate(("row_id", "prompt", "reference_images", "video", "feedback", "gold", "prediction"), 1))
_FILLED = "CASE WHEN regexp_matches({0}, '\\S') THEN {1} END"
_TRIM = lambda n: f"regexp_replace(x->>'{n}', '^\\s+|\\s+$', '', 'g')"
_SECONDS = lambda k: f"CAST(nullif(regexp_extract({_TRIM('时间区间')}, '{_SPAN}', {k}), '') AS DOUBLE)"

ORACLE = {
    "p6_found": f"{WITH} " + " UNION ".join(f"SELECT {_key(i)} FROM {t}" for i, t in enumerate(("issue", "evidence", "obs", "alt"))),
    "p6_issues": _subtype("issue"),
    "p6_evidence": _subtype("evidence"),
    "p6_observations": _subtype("obs"),
    "p6_alternatives": _subtype("alt"),
    "p7_found": f"WITH {LINES} SELECT line_id, fail_reason FROM judged WHERE fail_reason IS NOT NULL",
    "p7_loaded": f"""WITH {LINES} SELECT line_id, {_HEADS}, {_FILLED.format('gold', 'json_array_length(' + _gold('gold') + ')::INT')} AS gold_issues,
        {_FILLED.format('prediction', 'json_array_length(prediction)::INT')} AS predicted_issues FROM judged WHERE fail_reason IS NULL""",
    "p7_issues": f"""WITH {LINES}, ok AS (SELECT line_id, CASE WHEN regexp_matches(prediction, '\\S') THEN from_json(prediction, '["json"]') END AS l FROM judged WHERE fail_reason IS NULL),
        each AS (SELECT line_id, unnest(l) AS x, generate_subscripts(l, 1)::INT AS issue_pos FROM ok)
        SELECT line_id, issue_pos, {_TRIM('可定位性')} AS localizable, {_TRIM('置信度')} AS confidence, x->>'问题说明' AS description, x->>'问题类型' AS issue_type,
        {_SECONDS(1)} AS start_sec, {_SECONDS(2)} AS end_sec, x->>'关键帧秒' AS keyframe_sec, x->>'BBox' AS bbox FROM each""",
}
