"""Queries over speech and subtitle timelines, embeddings, orders and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.geometry import boxes_overlap, expanded_box, interval_gap, likely_subtitle, midpoint, nearby_boxes
from tessera.functions.textops import compact_text, event_tags, strip_event_tags
from tessera.functions.timeops import to_ms
from tessera.operators import contracts, crosstabs, matching, vectors
from tessera.operators.greedy import merge_captions, spatially_distinct
from tessera.operators.intervals import overlap_join
from tessera.plans import alignment
from tessera.runtime import shared_folder, table
from tessera.streaming import sessions as streams

WIDTH = 10_000


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "speech_segments")
    return s.select("seg_id", "sample_id", to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e"), "text", "speaker", "pos").distinct()


def _subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "subtitle_segments")
    return s.select("sub_id", "sample_id", to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e"), "text", "bbox", "confidence", "source").distinct()


def speech_word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "speech_segments").dropDuplicates(["seg_id"])
    return s.select("seg_id", crosstabs.word_confidence(F.col("words")).alias("level"))


def speech_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speech(spark, sf_dir).select(F.explode(event_tags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("segments"))


def speech_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speech(spark, sf_dir).select("seg_id", strip_event_tags(F.col("text")).alias("plain"))


def speech_shared_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with more than one speaker label."""
    s = _speech(spark, sf_dir).where("sample_id IS NOT NULL AND speaker IS NOT NULL")
    return crosstabs.shared_keys(s, "sample_id", "speaker").select("sample_id", F.size("others").alias("labels"), F.array_join("others", "|").alias("others"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sub = _subtitles(spark, sf_dir).select("sample_id", "sub_id", F.col("s").alias("l_start"), F.col("e").alias("l_end"), "text")
    seg = _speech(spark, sf_dir).select("sample_id", F.col("seg_id").alias("pos"), F.col("s").alias("r_start"), F.col("e").alias("r_end"), F.col("text").alias("heard_text"))
    return sub, seg


def caption_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles and speech of a clip that overlap."""
    sub, seg = _sides(spark, sf_dir)
    return overlap_join(sub.drop("text"), seg.drop("heard_text"), ["sample_id"], WIDTH).select("sub_id", F.col("pos").alias("seg_id"))


def caption_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speech under each subtitle as one text."""
    sub, seg = _sides(spark, sf_dir)
    out = matching.texts_heard(sub, seg.where("heard_text IS NOT NULL"), ["sample_id"], "sub_id", WIDTH)
    return out.select("sub_id", "heard", "segments")


def caption_text_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles whose own text is spoken within three seconds, but not while they show."""
    sub, seg = _sides(spark, sf_dir)
    left = sub.where("l_end > l_start").withColumn("norm", compact_text(F.col("text")))
    right = seg.where("r_end > r_start").withColumn("norm", compact_text(F.col("heard_text"))).withColumnRenamed("pos", "seg_id")
    return matching.same_text_elsewhere(left, right, "sample_id", "sub_id", "seg_id", 3000, WIDTH)


def caption_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the overlap graph of the two timelines."""
    speech = _speech(spark, sf_dir).select("sample_id", F.col("seg_id").cast("string").alias("seg_id"), F.col("s").alias("l_start"), F.col("e").alias("l_end"))
    subs = _subtitles(spark, sf_dir).select("sample_id", F.col("sub_id").cast("string").alias("sub_id"), F.col("s").alias("r_start"), F.col("e").alias("r_end"))
    return alignment.overlap_components(speech, subs, "sample_id", WIDTH)


def caption_component_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is heard and what is shown in each component, in order of time, and the languages of both."""
    speech = _speech(spark, sf_dir).select("sample_id", F.col("seg_id").cast("string").alias("seg_id"), F.col("s").alias("l_start"), F.col("e").alias("l_end"), "text")
    subs = _subtitles(spark, sf_dir).select("sample_id", F.col("sub_id").cast("string").alias("sub_id"), F.col("s").alias("r_start"), F.col("e").alias("r_end"), "text")
    nodes = alignment.overlap_components(speech, subs, "sample_id", WIDTH)
    out = alignment.component_texts(nodes, speech.where("text IS NOT NULL"), subs.where("text IS NOT NULL"))
    return out.select("component", "heard", "shown", "start", "heard_family", "shown_family")


def caption_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed captions merged into segments."""
    s = _subtitles(spark, sf_dir).where("sample_id IS NOT NULL AND bbox IS NOT NULL")
    obs = s.select("sample_id", F.col("sub_id").alias("pos"), (F.col("s") / 1000.0).alias("t"), "text", ((F.col("bbox.x1") + F.col("bbox.x2")) / 2).alias("cx"), ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("cy"), "confidence")
    return merge_captions(obs, "sample_id", 2.0)


def caption_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry of subtitle boxes against a frame in the lower third."""
    box = F.col("bbox")
    frame = F.struct(F.lit(0.1).alias("x1"), F.lit(0.7).alias("y1"), F.lit(0.9).alias("x2"), F.lit(0.95).alias("y2"))
    return _subtitles(spark, sf_dir).where("bbox IS NOT NULL").select(
        "sub_id", boxes_overlap(box, frame).alias("touches"), likely_subtitle(box).alias("likely"), nearby_boxes(box, frame).alias("near"), F.round(expanded_box(box, 0.05)["x1"] * 10000).cast("int").alias("wide_x1"),
        midpoint(F.col("s").cast("double"), F.col("e").cast("double")).alias("middle"),
    )


def caption_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's subtitles of a clip minute at most three, spatially distinct, by confidence."""
    s = _subtitles(spark, sf_dir).where("sample_id IS NOT NULL AND bbox IS NOT NULL AND s IS NOT NULL")
    rows = s.select(F.concat_ws("/", "sample_id", F.floor(F.col("s") / 60000).cast("string")).alias("minute"), F.col("sub_id").alias("pos"), "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), ((F.col("bbox.x1") + F.col("bbox.x2")) / 2).alias("cx"), ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("cy"))
    return spatially_distinct(rows, ["minute"], ["confidence"]).select("minute", "pos")


def caption_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance in time of each subtitle to its clip's first speech."""
    first = contracts.first_wins(_speech(spark, sf_dir).where("sample_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL").select("sample_id", "s", "e", F.struct("s", "seg_id").alias("o")), ["sample_id"], "o")
    sub = _subtitles(spark, sf_dir).where("s IS NOT NULL AND e IS NOT NULL")
    joined = sub.join(first.select("sample_id", F.col("s").alias("fs"), F.col("e").alias("fe")), "sample_id")
    return joined.select("sub_id", interval_gap(F.col("s").cast("double"), F.col("e").cast("double"), F.col("fs").cast("double"), F.col("fe").cast("double")).alias("gap"))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of like vectors of the whole table."""
    return vectors.all_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.2).select("left_id", "right_id", F.round(F.col("cosine") * 10000).cast("int").alias("cosine"))


def embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors.block_quality(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return q.select("block", "members", "pairs", *[F.round(F.col(c) * 10000).cast("int").alias(c) for c in ("mean_cosine", "min_cosine", "max_cosine")])


def order_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their lines: complete LEFT join with counts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    out = contracts.complete_left_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", {"lines": 0, "quantity": 0.0})
    return out.select("o_orderkey", "o_custkey", "lines", "quantity", "found")


def order_last_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("order"))
    return contracts.last_wins(o, "o_custkey", "order").select("o_custkey", "o_orderkey", "o_totalprice")


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    path = f"{shared_folder(spark)}/stream_{uuid4().hex}"
    return streams.drain(stream, path, f"{path}_state", mode)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.file_stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events"))


def stream_hourly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling hours over the event file as a stream, complete mode."""
    out = _drained(spark, streams.tumbling_values(_event_stream(spark, sf_dir), "ts", "value"), "complete")
    return out.select(F.unix_millis("start").alias("start_ms"), "events", F.round(F.col("total") * 100).cast("bigint").alias("cents"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: six-hour sessions of a stream, the open ones at its end among them."""
    out = _drained(spark, streams.session_counts(_event_stream(spark, sf_dir), "user_id", "ts"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


def stream_running_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: state kept by key; the highest of the maxima that were emitted, however the files fell into batches."""
    out = _drained(spark, streams.running_maximum(_event_stream(spark, sf_dir), "user_id", "value"), "append")
    return out.groupBy("key").agg(F.max("top").alias("top"))


QUERIES = {
    f.__name__: f
    for f in (
        speech_word_confidence, speech_tag_counts, speech_stripped, speech_shared_labels, caption_overlaps, caption_heard, caption_text_elsewhere, caption_components, caption_component_texts, caption_merge, caption_boxes,
        caption_distinct, caption_gaps, embedding_pairs, embedding_quality, order_line_ranges, order_last_of_customer, stream_hourly_values, stream_sessions, stream_running_maximum,
    )
}

_MS = "CAST(round({c} * 1000) AS BIGINT)"
_SEG = f"seg AS (SELECT DISTINCT seg_id, sample_id, {_MS.format(c='start_sec')} AS s, {_MS.format(c='end_sec')} AS e, text, speaker FROM speech_segments)"
_SUB = f"sub AS (SELECT DISTINCT sub_id, sample_id, {_MS.format(c='start_sec')} AS s, {_MS.format(c='end_sec')} AS e, text, bbox FROM subtitle_segments)"

_COMPONENTS = """WITH RECURSIVE a AS (SELECT DISTINCT seg_id, sample_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM speech_segments),
        b AS (SELECT DISTINCT sub_id, sample_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e FROM subtitle_segments),
        p AS (SELECT DISTINCT 's:' || seg_id AS x, 't:' || sub_id AS y FROM a JOIN b USING (sample_id) WHERE a.e > a.s AND b.e > b.s AND least(a.e, b.e) > greatest(a.s, b.s)),
        edge AS (SELECT x, y FROM p UNION SELECT y, x FROM p), reach AS (SELECT x AS node, x AS other FROM edge UNION SELECT r.node, edge.y FROM reach r JOIN edge ON edge.x = r.other),
        nodes AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

ORACLE = {
    "speech_word_confidence": """WITH d AS (SELECT DISTINCT seg_id, words FROM speech_segments), m AS (SELECT seg_id, list_avg(list_transform(words, lambda w: w.probability)) AS p FROM d)
        SELECT seg_id, CASE WHEN p >= 0.8 THEN 'high' WHEN p IS NOT NULL THEN 'medium' END AS level FROM m""",
    "speech_tag_counts": f"WITH {_SEG}, t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '<\\|([^|<>]+)\\|>', 1))) AS tag FROM seg) SELECT tag, count(*) AS segments FROM t GROUP BY tag",
    "speech_stripped": f"""WITH {_SEG} SELECT seg_id, regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]*>|[♪♫🎵]', ' ', 'g'), '\\s+', ' ', 'g'), '^[\\s\\p{{P}}]+|[\\s\\p{{P}}]+$', '', 'g') AS plain FROM seg""",
    "speech_shared_labels": f"""WITH {_SEG}, d AS (SELECT DISTINCT sample_id, speaker FROM seg WHERE sample_id IS NOT NULL AND speaker IS NOT NULL)
        SELECT sample_id, count(*) AS labels, string_agg(speaker, '|' ORDER BY speaker) AS others FROM d GROUP BY sample_id HAVING count(*) > 1""",
    "caption_overlaps": f"WITH {_SEG}, {_SUB} SELECT sub_id, seg_id FROM sub JOIN seg USING (sample_id) WHERE sub.e > sub.s AND seg.e > seg.s AND least(sub.e, seg.e) > greatest(sub.s, seg.s)",
    "caption_heard": f"""WITH {_SEG}, {_SUB} SELECT sub_id, string_agg(seg.text, ' ' ORDER BY seg.s, seg_id) AS heard, count(*) AS segments FROM sub JOIN seg USING (sample_id)
        WHERE seg.text IS NOT NULL AND sub.e > sub.s AND seg.e > seg.s AND least(sub.e, seg.e) > greatest(sub.s, seg.s) GROUP BY sub_id""",
    "caption_text_elsewhere": f"""WITH {_SEG}, {_SUB}, n AS (SELECT sub_id, seg_id, greatest(sub.s, seg.s) - least(sub.e, seg.e) AS gap FROM sub JOIN seg USING (sample_id)
        WHERE sub.e > sub.s AND seg.e > seg.s AND regexp_replace(lower(sub.text), '[^\\p{{L}}\\p{{N}}]', '', 'g') = regexp_replace(lower(seg.text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AND regexp_replace(lower(sub.text), '[^\\p{{L}}\\p{{N}}]', '', 'g') <> '')
        SELECT sub_id, arg_min(seg_id, (gap, seg_id)) AS seg_id, min(gap) AS gap FROM n WHERE gap BETWEEN 0 AND 3000 AND sub_id NOT IN (SELECT sub_id FROM n WHERE gap < 0) GROUP BY sub_id""",
    "caption_boxes": f"""WITH {_SUB}, b AS (SELECT *, (bbox.x1 + bbox.x2) / 2 AS cx, (bbox.y1 + bbox.y2) / 2 AS cy FROM sub WHERE bbox IS NOT NULL)
        SELECT sub_id, least(bbox.x2, 0.9::DOUBLE) > greatest(bbox.x1, 0.1::DOUBLE) AND least(bbox.y2, 0.95::DOUBLE) > greatest(bbox.y1, 0.7::DOUBLE) AS touches, abs(cx - 0.5::DOUBLE) <= 0.2::DOUBLE AND cy >= 0.55::DOUBLE AND bbox.x2 - bbox.x1 >= 0.35::DOUBLE AS likely,
        abs(cx - (0.1::DOUBLE + 0.9::DOUBLE) / 2) <= 0.15::DOUBLE AND abs(cy - (0.7::DOUBLE + 0.95::DOUBLE) / 2) <= 0.12::DOUBLE AS near, CAST(round(greatest(0, bbox.x1 - 0.05::DOUBLE) * 10000) AS INT) AS wide_x1,
        CASE WHEN e IS NULL THEN CAST(s AS DOUBLE) ELSE (s + e) / 2.0 END AS middle FROM b""",
    "caption_gaps": f"""WITH {_SEG}, {_SUB}, f AS (SELECT sample_id, s, e FROM seg WHERE sample_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s, seg_id) = 1)
        SELECT sub_id, CAST(greatest(0, greatest(sub.s, f.s) - least(sub.e, f.e)) AS DOUBLE) AS gap FROM sub JOIN f USING (sample_id) WHERE sub.s IS NOT NULL AND sub.e IS NOT NULL""",
    "stream_sessions": """WITH s AS (SELECT user_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS b FROM s),
        g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM f)
        SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS events FROM g GROUP BY user_id, n""",
    "stream_running_maximum": "SELECT user_id AS key, max(value) AS top FROM events GROUP BY user_id",
    "caption_components": f"""{_COMPONENTS} SELECT * FROM nodes""",
    "caption_component_texts": f"""{_COMPONENTS}, t AS (SELECT component, 'heard' AS side, a.s AS at_ms, CAST(a.seg_id AS VARCHAR) AS id, x.text FROM nodes JOIN a ON node = 's:' || a.seg_id JOIN (SELECT DISTINCT seg_id, text FROM speech_segments) x ON x.seg_id = a.seg_id WHERE x.text IS NOT NULL
          UNION ALL SELECT component, 'shown', b.s, CAST(b.sub_id AS VARCHAR), x.text FROM nodes JOIN b ON node = 't:' || b.sub_id JOIN (SELECT DISTINCT sub_id, text FROM subtitle_segments) x ON x.sub_id = b.sub_id WHERE x.text IS NOT NULL),
        g AS (SELECT component, coalesce(string_agg(text, ' ' ORDER BY at_ms, id) FILTER (side = 'heard'), '') AS heard, coalesce(string_agg(text, ' ' ORDER BY at_ms, id) FILTER (side = 'shown'), '') AS shown, min(at_ms) AS start FROM t GROUP BY component),
        n AS (SELECT *, length(regexp_replace(heard, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) AS hh, length(regexp_replace(heard, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS hl, length(regexp_replace(shown, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) AS sh, length(regexp_replace(shown, '[^A-Za-zÀ-ÖØ-öø-ɏ]', '', 'g')) AS sl FROM g)
        SELECT component, heard, shown, start, CASE WHEN hh >= 2 AND hh >= hl THEN 'zh' WHEN hl >= 2 AND hl > hh THEN 'latin' ELSE 'unknown' END AS heard_family, CASE WHEN sh >= 2 AND sh >= sl THEN 'zh' WHEN sl >= 2 AND sl > sh THEN 'latin' ELSE 'unknown' END AS shown_family FROM n""",
    "caption_distinct": """WITH RECURSIVE s AS (SELECT DISTINCT sub_id, sample_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, text, bbox, coalesce(confidence, 0) AS c FROM subtitle_segments WHERE sample_id IS NOT NULL AND bbox IS NOT NULL AND start_sec IS NOT NULL),
        r AS (SELECT sample_id || '/' || CAST(floor(s / 60000) AS BIGINT) AS minute, sub_id AS pos, {'t': text, 'x': (bbox.x1 + bbox.x2) / 2, 'y': (bbox.y1 + bbox.y2) / 2} AS v, row_number() OVER (PARTITION BY sample_id || '/' || CAST(floor(s / 60000) AS BIGINT) ORDER BY c DESC, sub_id) AS n FROM s),
        g AS (SELECT minute, n, [v] AS kept, [pos] AS ids FROM r WHERE n = 1 UNION ALL
          SELECT r.minute, r.n, CASE WHEN ok THEN list_append(kept, v) ELSE kept END, CASE WHEN ok THEN list_append(ids, pos) ELSE ids END FROM (SELECT r.*, g.kept, g.ids, len(g.kept) < 3 AND len(list_filter(g.kept, lambda k: k.t IS NOT DISTINCT FROM r.v.t AND abs(k.x - r.v.x) <= 0.15 AND abs(k.y - r.v.y) <= 0.12)) = 0 AS ok FROM g JOIN r ON r.minute = g.minute AND r.n = g.n + 1) r)
        SELECT minute, unnest(ids) AS pos FROM (SELECT minute, arg_max(ids, n) AS ids FROM g GROUP BY minute)""",
    "embedding_pairs": """WITH p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
        SELECT left_id, right_id, CAST(round(c * 10000) AS INT) AS cosine FROM p WHERE c >= 0.2""",
    "embedding_quality": """WITH p AS (SELECT a.label AS block, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
        n AS (SELECT label AS block, count(*) AS members FROM embeddings GROUP BY label)
        SELECT block, members, CAST(members * (members - 1) // 2 AS BIGINT) AS pairs, CAST(round(avg(c) * 10000) AS INT) AS mean_cosine, CAST(round(min(c) * 10000) AS INT) AS min_cosine, CAST(round(max(c) * 10000) AS INT) AS max_cosine FROM n LEFT JOIN p USING (block) GROUP BY block, members""",
    "order_line_ranges": """WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, o_custkey, coalesce(lines, 0) AS lines, coalesce(quantity, 0) AS quantity, l_orderkey IS NOT NULL AS found FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "order_last_of_customer": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "stream_hourly_values": "SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS start_ms, count(*) AS events, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL",
}
