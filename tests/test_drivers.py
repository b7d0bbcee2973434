from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.plans import drivers as D


def test_paths(spark):
    cases = {
        "a/b.mp4": ("/data/a/b.mp4", None), "/data/a.mp4": ("/data/a.mp4", None), "./a//b": ("/data/a/b", None), "a/../b": ("/data/b", None), " a b ": ("/data/a b", None),
        "../x": (None, "outside"), "/etc/passwd": (None, "outside"), "a/../../x": (None, "outside"), "/database/x": (None, "outside"), "../../../data/x": ("/data/x", None),
        "https://h/x": (None, "url"), "FILE:///data/x": (None, "url"), "": (None, "empty"), "  ": (None, "empty"), None: (None, "empty"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: (r.x.path, r.x.error) for r in df.select("p", D.path_under(F.col("p"), "/data/").alias("x")).collect()}
    assert got == cases


def test_stages_stop_their_row_only(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    stages = [("read", F.col("v") + 1, F.when(F.col("v").isNull(), "missing")), ("check", F.col("read_value") * 2, F.when(F.col("v") < 0, "negative")), ("write", F.lit("done"), F.lit(None).cast("string"))]
    got = {r.k: r for r in D.staged(df, stages).collect()}
    assert [got[k].write_status for k in (1, 2, 3)] == ["ok", "skipped", "skipped"] and [got[k].failed_stage for k in (1, 2, 3)] == [None, "read", "check"]
    assert (got[1].check_value, got[2].check_error, got[3].check_error, got[3].read_value) == (12, None, "negative", 0)
    assert D.staged(df.limit(0), stages).collect() == []


def test_matrix_outcomes_and_rest(spark):
    runs = D.run_matrix(spark, {"m": ["a", "b"], "n": ["1"]}, "x {m} {n} {m}").orderBy("run").collect()
    assert [(r.run, r.command) for r in runs] == [(1, "x a 1 a"), (2, "x b 1 b")]
    assert D.run_matrix(spark, {"m": []}, "x").collect() == []
    log = spark.createDataFrame([(1, 1, "start"), (1, 9, "end"), (2, 4, "start"), (7, 1, "other")], "run int, position int, status string")
    exits = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "run int, exit_code int")
    got = {r.run: (r.last_record, r.lines, r.failed) for r in D.run_outcomes(exits, log, "run", "position", "status").collect()}
    assert got == {1: ("end", 2, False), 2: ("start", 1, True), 3: (None, 0, None)}
    done = spark.createDataFrame([(1, 1, "ok"), (1, 2, "failed"), (2, 1, "failed"), (2, 2, "ok")], "run int, position int, status string")
    assert sorted(r.run for r in D.remaining(exits, done, "run").collect()) == [1, 3]


def test_fallback_and_payload(spark):
    df = spark.createDataFrame([(1, ["a"], ["b"]), (2, [], ["b"]), (3, None, None)], "k int, a array<string>, b array<string>")
    got = {r.k: (r.x, json.loads(r.p)) for r in df.select("k", D.first_available(F.col("a"), F.col("b")).alias("x"), D.review_payload({"id": F.col("k").cast("string"), "none": F.lit(None).cast("string")}, {"A": F.try_element_at("a", F.lit(1))}).alias("p")).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == [["a"], ["b"], []]
    assert got[3][1] == {"id": "3", "none": "", "predictions": [{"source": "A", "prediction": "[]"}]} and got[1][1]["predictions"][0]["prediction"] == "a"
