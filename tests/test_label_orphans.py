from __future__ import annotations

from tessera.queries.texts import QUERIES


def test_every_document_counts(spark, tmp_path):
    """Multiples of 5 and other kinds too; a label is an orphan only if its document is missing."""
    docs = [(5, "feedback"), (6, "prompt"), (7, "feedback"), (10, "prompt"), (10, "prompt")]
    spark.createDataFrame(docs, "doc_id bigint, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5,), (6,), (6,), (99,)], "doc_id bigint").write.parquet(f"{tmp_path}/review_labels.parquet")
    got = {tuple(r) for r in QUERIES["label_orphans"](spark, str(tmp_path)).collect()}
    assert got == {("left", 7), ("left", 10), ("right", 99)}
