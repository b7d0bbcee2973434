"""Queries that write to the shared folder and read again: sources and sinks against the tables they came from."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import contracts
from tessera.runtime import shared_folder, table
from tessera.sources import files, sinks
from tessera.streaming import sessions as streams

KINDS = ("prompt", "feedback", "transcript", "subtitle_dump", "issue_report", "gold_note", "run_log")


def _target(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/roundtrip_{uuid4().hex}"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").select("pred_id", "row_index", "sample_id", "prediction_source", "prediction").dropDuplicates(["pred_id"])


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as CSV beside their target, committed, and read with fixed names; nulls come back as ''."""
    s = table(spark, sf_dir, "samples").drop("logged_at").dropDuplicates(["row_index"])
    path = _target(spark)
    one_line = s.select(F.col("row_index").cast("string").alias("row_index"), *[F.regexp_replace(c, r"\r", " ").alias(c) for c in files.SAMPLE_COLUMNS])
    sinks.commit_staged(one_line, path, "csv", header="true", escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", emptyValue="", nullValue="")
    back = files.read_csv(spark, path, ("row_index", *files.SAMPLE_COLUMNS))
    return back.select(F.col("row_index").cast("bigint").alias("row_index"), *files.SAMPLE_COLUMNS, files.cell(back, "absent").alias("absent"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as JSON lines twice: the second time nothing is new. Valid rows and the lines that do not parse."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    path = _target(spark)
    added = [sinks.append_new(e, path, "event_id") for _ in range(2)]
    bad = spark.createDataFrame([('{"event_id": ',), ("",), ("[1",)], "value string")
    bad.write.mode("append").text(path)
    rows, broken = files.read_jsonl(spark, path, "event_id bigint, event_type string, value double")
    count = broken.groupBy().agg(F.count(F.lit(1)).alias("event_id")).select("event_id", F.lit(f"broken lines, added {added[1]} again").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return rows.select("event_id", "event_type", "value").unionByName(count)


def package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package a kind of document, each a folder with a JSON document, read as parsed documents."""
    n = table(spark, sf_dir, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))
    path = _target(spark)
    sinks.commit_staged(n.coalesce(1), path, "json", ["doc_kind"])
    docs = files.read_packages(spark, path)
    return docs.select(F.regexp_replace("sample", "^doc_kind=", "").alias("doc_kind"), F.try_variant_get("content", "$.documents", "bigint").alias("documents"), F.try_variant_get("content", "$.characters", "bigint").alias("characters"))


def sidecar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-car texts by stem, and those that hold a marker of ground truth."""
    d = table(spark, sf_dir, "review_labels").groupBy("reviewer").agg(F.count(F.lit(1)).alias("n")).where("reviewer IS NOT NULL")
    path = _target(spark)
    d.select(F.format_string("%s: %d labels, expected", "reviewer", "n").alias("value"), F.col("reviewer")).coalesce(1).write.partitionBy("reviewer").text(path)
    texts = files.read_sidecars(spark, f"{path}/*")
    found = files.leaks(texts, "text", ["EXPECTED"])
    return found.select(F.trim(F.regexp_replace("text", r"\s+$", "")).alias("text"), (F.length("stem") > 0).alias("named"))


def partitioned_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions committed by source: what comes back is what went in, and a second commit is refused."""
    p = _predictions(spark, sf_dir)
    path = _target(spark)
    sinks.commit_staged(p, path, partition_by=["prediction_source"])
    try:
        sinks.commit_staged(p, path)
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.parquet(path).groupBy("prediction_source").agg(F.count(F.lit(1)).alias("predictions"), F.sum(F.length("prediction")).alias("characters"), F.sum("pred_id").alias("ids")).withColumn("refused", F.lit(refused))


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as import records with a key."""
    return sinks.import_records(_predictions(spark, sf_dir).select("row_index", "pred_id", "prediction_source"), "row_index", "pred_id")


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of report a source."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs")).where("source IS NOT NULL")
    return sinks.report(n, "%s: %d documents in %d languages", ["source", "n", "langs"])


def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label in batches of about a hundred: how many of them, and that none is over three hundred."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    b = contracts.batches(d, ["doc_id"], table(spark, sf_dir, "review_labels"), "doc_id")
    sizes = b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("rows"), (F.max("n") <= 300).alias("small"))


def duplicate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels given twice: the first, the last, or all with a mark."""
    r = table(spark, sf_dir, "review_labels").select("doc_id", "reviewer", F.struct("reviewed_at", "reviewer").alias("order")).distinct()
    part = lambda policy: contracts.on_duplicate(r, "doc_id", "order", policy).select(F.lit(policy).alias("policy"), "doc_id", "reviewer", F.lit(None).cast("boolean").alias("is_duplicate"))
    marked = contracts.on_duplicate(r, "doc_id", "order", "error").select(F.lit("error").alias("policy"), "doc_id", "reviewer", "is_duplicate")
    return part("first").unionByName(part("last")).unionByName(marked)


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a stream appended exactly once by key, run twice over the same files."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    path, source = _target(spark), f"{sf_dir}/event[s].parquet"
    for k in range(2):
        streams.append_stream(streams.file_stream(spark, source, events), path, "event_id", f"{path}_state_{k}")
    return spark.read.schema(events.schema).json(path)


QUERIES = {f.__name__: f for f in (csv_roundtrip, jsonl_roundtrip, package_roundtrip, sidecar_roundtrip, partitioned_commit, import_rows, source_report, upload_batches, duplicate_policies, stream_append)}

_CELLS = ", ".join(f"coalesce(replace({c}, chr(13), ' '), '') AS {c}" for c in files.SAMPLE_COLUMNS)
_P = "p AS (SELECT DISTINCT pred_id, row_index, prediction_source, prediction FROM predictions)"

ORACLE = {
    "csv_roundtrip": f"SELECT DISTINCT row_index, {_CELLS}, '' AS absent FROM samples",
    "jsonl_roundtrip": "SELECT event_id, event_type, value FROM events UNION ALL SELECT 2, 'broken lines, added 0 again', NULL",
    "package_roundtrip": "SELECT doc_kind, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY doc_kind",
    "sidecar_roundtrip": "SELECT reviewer || ': ' || count(*) || ' labels, expected' AS text, true AS named FROM review_labels WHERE reviewer IS NOT NULL GROUP BY reviewer",
    "partitioned_commit": f"WITH {_P} SELECT prediction_source, count(*) AS predictions, CAST(sum(length(prediction)) AS BIGINT) AS characters, CAST(sum(pred_id) AS BIGINT) AS ids, true AS refused FROM p GROUP BY prediction_source",
    "import_rows": f"""WITH {_P} SELECT row_index || ':' || pred_id AS import_key, '{{"fields":{{"row_index":' || row_index || ',"pred_id":' || pred_id || ',"prediction_source":"' || prediction_source || '"}}}}' AS record FROM p""",
    "source_report": "SELECT source || ': ' || count(*) || ' documents in ' || count(DISTINCT lang) || ' languages' AS line FROM documents WHERE source IS NOT NULL GROUP BY source",
    "upload_batches": "SELECT count(*) AS rows, true AS small FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM review_labels WHERE doc_id IS NOT NULL)",
    "duplicate_policies": """WITH r AS (SELECT DISTINCT doc_id, reviewer, reviewed_at FROM review_labels), n AS (SELECT doc_id, count(*) > 1 AS d FROM r GROUP BY doc_id)
        SELECT 'first' AS policy, doc_id, arg_min(reviewer, (reviewed_at, reviewer)) AS reviewer, NULL::BOOLEAN AS is_duplicate FROM r GROUP BY doc_id
        UNION ALL SELECT 'last', doc_id, arg_max(reviewer, (reviewed_at, reviewer)), NULL FROM r GROUP BY doc_id UNION ALL SELECT 'error', doc_id, reviewer, d FROM r JOIN n USING (doc_id)""",
    "stream_append": "SELECT event_id, user_id, value FROM events",
}
