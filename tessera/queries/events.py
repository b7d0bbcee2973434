"""Queries over the event table: sessions, runs, interval joins, robust statistics, tool traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.geometry import sync_gate, sync_score
from tessera.operators import crosstabs, greedy, matching, runs
from tessera.operators.intervals import overlap_join
from tessera.runtime import table

HOUR = 3_600_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return e.withColumn("user", F.col("user_id").cast("string"))


def _span(e: DataFrame, kind: str, side: str, minutes: int, key: str) -> DataFrame:
    return e.where(F.col("event_type") == kind).select("user", F.col("event_id").alias(key), F.col("ms").alias(f"{side}_start"), (F.col("ms") + minutes * 60_000).alias(f"{side}_end"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps up to six hours."""
    rows = runs.sessions(_events(spark, sf_dir).select("user", "ms", "event_id", "value"), "user", "ms", "event_id", 6 * HOUR)
    return rows.groupBy("user", "run_start").agg(F.count(F.lit(1)).alias("events"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


def event_first_seen_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.first_seen_relabel(_events(spark, sf_dir).select("user", "event_id", "event_type"), "user", "event_type", "event_id")
    return out.select("user", "event_id", "event_type", "label_no")


def event_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour intervals of neighbouring events of one type, at most an hour apart, as one."""
    e = _events(spark, sf_dir).select("user", "event_type", "event_id", "ms", (F.col("ms") + HOUR // 2).alias("end_ms"))
    return runs.merge_adjacent(e, "user", "event_type", "event_id", "ms", "end_ms", HOUR)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of three consecutive events of a user."""
    e = runs.numbered(_events(spark, sf_dir).select("user", "ms", "event_id", "event_type"), "user", ["ms", "event_id"])
    return runs.windows(e.select("user", "sequence", "event_type"), "user", "sequence", 3, ["event_type"]).select(
        "user", "pos", F.array_join(F.transform("window", lambda w: w["event_type"]), ">").alias("types")
    )


def event_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return overlap_join(_span(e, "view", "l", 240, "view_id"), _span(e, "click", "r", 90, "click_id"), ["user"], 3 * HOUR).select("view_id", "click_id")


def event_largest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    turns = _span(e, "click", "r", 90, "pos").withColumn("label", F.concat(F.lit("c"), F.col("pos").cast("string")))
    return matching.largest_overlap(_span(e, "view", "l", 240, "view_id"), turns, ["user"], "view_id", "label", 3 * HOUR, "none")


def event_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return matching.veto(_span(e, "purchase", "l", 120, "event_id"), _span(e, "error", "r", 120, "pos"), ["user"], "event_id", 3 * HOUR).select("event_id", "vetoed_by")


def event_veto_with_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kept = matching.veto_with_rescue(_span(e, "purchase", "l", 240, "event_id"), _span(e, "error", "r", 240, "x"), _span(e, "signup", "r", 240, "x"), ["user"], "event_id", 6 * HOUR)
    return kept.select("event_id")


def event_in_order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone matches of views to clicks within an hour."""
    side = lambda k: _events(spark, sf_dir).where(F.col("event_type") == k).select("user", (F.col("ms") / 1000.0).alias("t"), F.col("event_id").alias("pos"))
    return greedy.match_in_order(side("view"), side("click"), "user", 3600.0)


def event_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events of one user and type within two hours the one with the higher value."""
    e = _events(spark, sf_dir).select("user", "event_type", (F.col("ms") / 1000.0).alias("t"), F.col("event_id").alias("pos"), "value")
    return greedy.suppress_near(e, "user", "event_type", "t", ["value"], 7200.0).select("user", "event_type", "pos")


def event_span_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user", F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"), (F.col("ms") / 1000.0).alias("start_sec"), (F.col("ms") / 1000.0 + 600).alias("end_sec"))
    return greedy.span_capped_groups(e, "user", 86_400.0, 200_000.0).select("user", "pos", "run_start", "group_no")


def event_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstabs.sum_map(table(spark, sf_dir, "events"), F.from_json("props", "map<string,double>"))


def event_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstabs.robust_events(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")


def event_tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 20, "ok").when(F.col("value") < 30, "failed").otherwise("not_applicable")
    cache = F.when(F.col("event_id") % 3 == 0, "hit").otherwise("miss")
    return crosstabs.tool_stats(e.select(F.col("event_type").alias("tool"), cache.alias("cache"), status.alias("status")), "tool", "cache", "status")


def event_group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") > 60, "ok").when(F.col("value") > 40, "failed").otherwise("not_applicable"))
    level = F.when(F.col("value") > 80, "strong").when(F.col("value") > 30, "medium").otherwise("weak")
    return e.groupBy("user_id").agg(crosstabs.group_status(F.col("status")).alias("status"), crosstabs.strongest(level, ["weak", "medium", "strong"]).alias("level"))


def event_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate and score of synchronisation measurements taken from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", (k % 31 - 15).alias("offset"), (F.col("value") / 10).alias("confidence"))
    return e.select("event_id", sync_gate(F.col("confidence"), F.col("offset")).alias("gate"), F.round(sync_score(F.col("confidence"), F.col("offset")) * 1000).cast("bigint").alias("score_milli"))


def event_role_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = crosstabs.support(e.withColumn("turn", F.col("event_id") % 7), ["user_id", "event_type"], "value", "turn")
    return out.select("user_id", "event_type", F.round(F.col("duration") * 100).cast("bigint").alias("duration_cents"), "turns", "segments")


def event_top_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type with most events of each user, and its lead over the next."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.lit(1).alias("one"))
    return crosstabs.top_with_margin(e, "user_id", "event_type", "one").select("user_id", "event_type", "score", "margin")


QUERIES = {
    f.__name__: f
    for f in (
        event_sessions, event_first_seen_relabel, event_merge_adjacent, event_windows, event_overlaps, event_largest_overlap, event_veto, event_veto_with_rescue, event_in_order_matches,
        event_suppressed, event_span_groups, event_usage, event_robust, event_tool_stats, event_group_status, event_sync, event_role_support, event_top_type,
    )
}

_E = """e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS "user", user_id, event_type, value, props, epoch_us(ts) // 1000 AS ms FROM events)"""
_SPAN = """SELECT "user", event_id AS {key}, ms AS {s}s, ms + {m} * 60000 AS {s}e FROM e WHERE event_type = '{kind}'"""
_VC = f"WITH {_E}, l AS ({_SPAN.format(key='view_id', s='l', m=240, kind='view')}), r AS ({_SPAN.format(key='click_id', s='r', m=90, kind='click')})"

ORACLE = {
    "event_sessions": f"""WITH {_E}, f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 21600000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY "user" ORDER BY ms, event_id)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY "user" ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS n FROM f)
        SELECT "user", arg_min(event_id, (ms, event_id)) AS run_start, count(*) AS events, min(ms) AS start_ms, max(ms) AS end_ms FROM g GROUP BY "user", n""",
    "event_first_seen_relabel": f"""WITH {_E}, m AS (SELECT "user", event_type, min(event_id) AS f FROM e GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY f) - 1 AS label_no FROM m)
        SELECT e."user", e.event_id, e.event_type, d.label_no FROM e JOIN d USING ("user", event_type)""",
    "event_merge_adjacent": f"""WITH {_E}, k AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY "user" ORDER BY ms, event_id)),
        r AS (SELECT *, sum(b) OVER (PARTITION BY "user" ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM k),
        t AS (SELECT *, max(ms + 1800000) OVER (PARTITION BY "user", run ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
        g AS (SELECT *, sum(CASE WHEN top IS NULL OR ms - top > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY "user", run ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS n FROM t)
        SELECT "user", event_type, min(ms) AS ms, max(ms + 1800000) AS end_ms FROM g GROUP BY "user", run, n, event_type""",
    "event_windows": f"""WITH {_E}, s AS (SELECT "user", row_number() OVER w AS pos, event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY "user" ORDER BY ms, event_id))
        SELECT "user", pos, event_type || '>' || b || '>' || c AS types FROM s WHERE c IS NOT NULL""",
    "event_overlaps": f'{_VC} SELECT view_id, click_id FROM l JOIN r USING ("user") WHERE least(le, re) > greatest(ls, rs)',
    "event_largest_overlap": f"""{_VC}, h AS (SELECT view_id, click_id, row_number() OVER (PARTITION BY view_id ORDER BY least(le, re) - greatest(ls, rs) DESC, click_id) AS n FROM l JOIN r USING ("user") WHERE least(le, re) > greatest(ls, rs))
        SELECT view_id, coalesce('c' || click_id, 'none') AS label FROM l LEFT JOIN (SELECT * FROM h WHERE n = 1) USING (view_id)""",
    "event_veto": f"""WITH {_E}, l AS ({_SPAN.format(key='event_id', s='l', m=120, kind='purchase')}), r AS ({_SPAN.format(key='pos', s='r', m=120, kind='error')}),
        h AS (SELECT event_id, min(pos) AS vetoed_by FROM l JOIN r USING ("user") WHERE least(le, re) > greatest(ls, rs) AND (least(le, re) - greatest(ls, rs)) / least(le - ls, re - rs) >= 0.5 GROUP BY event_id)
        SELECT event_id, vetoed_by FROM l LEFT JOIN h USING (event_id)""",
    "event_veto_with_rescue": f"""WITH {_E}, l AS ({_SPAN.format(key='event_id', s='l', m=240, kind='purchase')}), b AS ({_SPAN.format(key='x', s='r', m=240, kind='error')}), g AS ({_SPAN.format(key='x', s='r', m=240, kind='signup')})
        SELECT event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b."user" = l."user" AND least(le, re) > greatest(ls, rs)) OR EXISTS (SELECT 1 FROM g WHERE g."user" = l."user" AND least(le, re) > greatest(ls, rs))""",
    "event_suppressed": f"""WITH RECURSIVE {_E}, r AS (SELECT "user", event_type, event_id AS pos, ms / 1000.0 AS t, row_number() OVER (PARTITION BY "user", event_type ORDER BY value DESC, ms, event_id) AS n FROM e WHERE value IS NOT NULL),
        g AS (SELECT "user", event_type, n, [t] AS kept, [pos] AS ids FROM r WHERE n = 1 UNION ALL
          SELECT "user", event_type, n, CASE WHEN ok THEN list_append(kept, t) ELSE kept END, CASE WHEN ok THEN list_append(ids, pos) ELSE ids END
          FROM (SELECT r."user", r.event_type, r.n, r.t, r.pos, g.kept, g.ids, len(list_filter(g.kept, lambda k: abs(k - r.t) <= 7200.0)) = 0 AS ok FROM g JOIN r ON r."user" = g."user" AND r.event_type = g.event_type AND r.n = g.n + 1))
        SELECT "user", event_type, unnest(ids) AS pos FROM (SELECT "user", event_type, arg_max(ids, n) AS ids FROM g GROUP BY ALL)""",
    "event_span_groups": f"""WITH RECURSIVE {_E}, o AS (SELECT "user", event_id AS pos, event_type AS speaker, ms / 1000.0 AS s, ms / 1000.0 + 600 AS f, row_number() OVER (PARTITION BY "user" ORDER BY ms, event_id) AS n FROM e),
        b AS (SELECT *, coalesce(s - lag(f) OVER w > 86400.0 OR speaker <> lag(speaker) OVER w, true) AS cut FROM o WINDOW w AS (PARTITION BY "user" ORDER BY n)),
        g AS (SELECT "user", n, pos, pos AS run_start, 0 AS group_no, s AS begin_s FROM b WHERE n = 1 UNION ALL
          SELECT b."user", b.n, b.pos, CASE WHEN b.cut THEN b.pos ELSE g.run_start END, CASE WHEN b.cut THEN 0 WHEN b.f - g.begin_s > 200000.0 THEN g.group_no + 1 ELSE g.group_no END, CASE WHEN b.cut OR b.f - g.begin_s > 200000.0 THEN b.s ELSE g.begin_s END
          FROM g JOIN b ON b."user" = g."user" AND b.n = g.n + 1)
        SELECT "user", pos, run_start, CAST(group_no AS INT) AS group_no FROM g""",
    "event_in_order_matches": f"""WITH RECURSIVE {_E}, l AS (SELECT "user", ms / 1000.0 AS t, event_id AS pos, row_number() OVER (PARTITION BY "user" ORDER BY ms, event_id) AS n FROM e WHERE event_type = 'view'),
        r AS (SELECT "user", ms / 1000.0 AS t, event_id AS pos, row_number() OVER (PARTITION BY "user" ORDER BY ms, event_id) AS i FROM e WHERE event_type = 'click'),
        near AS (SELECT l."user", l.n, list({{'gap': abs(r.t - l.t), 'i': r.i, 'pos': r.pos}} ORDER BY abs(r.t - l.t), r.i) AS c FROM l JOIN r ON l."user" = r."user" AND r.t BETWEEN l.t - 3600.0 AND l.t + 3600.0 GROUP BY ALL),
        g AS (SELECT "user", 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS left_pos, NULL::STRUCT(gap DOUBLE, i BIGINT, pos BIGINT) AS hit FROM (SELECT DISTINCT "user" FROM l) UNION ALL
          SELECT "user", n, coalesce(hit.i, used), pos, hit FROM (SELECT g."user", l.n, l.pos, g.used, list_filter(near.c, lambda x: x.i > g.used)[1] AS hit FROM g JOIN l ON l."user" = g."user" AND l.n = g.n + 1 LEFT JOIN near ON near."user" = l."user" AND near.n = l.n))
        SELECT "user", left_pos, hit.pos AS right_pos, hit.gap AS gap FROM g WHERE hit IS NOT NULL""",
    "event_usage": "SELECT 'k' AS key, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total FROM events",
    "event_robust": """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY ALL), d AS (SELECT event_type, any_value(med) AS med, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type),
        t AS (SELECT *, greatest(0.11, med + 4 * greatest(mad, 0.005)) AS threshold FROM d)
        SELECT event_type, any_value(med) AS med, any_value(mad) AS mad, any_value(threshold) AS threshold, count(*) FILTER (value > threshold) AS events FROM events JOIN t USING (event_type) GROUP BY event_type""",
    "event_tool_stats": """SELECT event_type AS tool, count(*) AS requests, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 3 <> 0) AS misses, count(*) FILTER (value < 20) AS ok,
        count(*) FILTER (value >= 20 AND value < 30) AS failed, count(*) FILTER (value >= 30) AS not_applicable FROM events GROUP BY event_type""",
    "event_group_status": """SELECT user_id, CASE WHEN max(value) > 60 THEN 'ok' WHEN max(value) > 40 THEN 'failed' ELSE 'not_applicable' END AS status,
        CASE WHEN max(value) > 80 THEN 'strong' WHEN max(value) > 30 THEN 'medium' ELSE 'weak' END AS level FROM events GROUP BY user_id""",
    "event_sync": """WITH m AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) % 31 - 15 AS o, value / 10 AS c FROM events)
        SELECT event_id, CASE WHEN abs(o) >= 15 THEN 'boundary' WHEN c < 3.0 THEN 'unreliable' WHEN abs(o) > 6 THEN 'flagged' ELSE 'ok' END AS gate,
        CAST(round(100 * (1 / (1 + exp(-c))) * exp(-abs(o) / 3.0) * 1000) AS BIGINT) AS score_milli FROM m""",
    "event_role_support": "SELECT user_id, event_type, CAST(round(sum(value) * 100) AS BIGINT) AS duration_cents, count(DISTINCT event_id % 7) AS turns, count(*) AS segments FROM events GROUP BY ALL",
    "event_top_type": """WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM g)
        SELECT a.user_id, a.event_type, a.n AS score, a.n - coalesce(b.n, 0) AS margin FROM c a LEFT JOIN c b ON a.user_id = b.user_id AND b.r = 2 WHERE a.r = 1""",
}
