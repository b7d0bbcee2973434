from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import components, contracts as C, crosstabs as X, greedy, matching as M, runs as R, vectors
from tessera.sources import files, sinks
from tessera.streaming import sessions as ST


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (" ", 3, "z"), (None, 4, None)], "k string, o int, v string")
    assert sorted((r.reason, r.n) for r in C.key_violations(df, "k").collect()) == [("blank", 1), ("blank", 1), ("duplicate", 2)]
    assert {r.k: r.v for r in C.on_duplicate(df, "k", "o", "last").collect()} == {"a": "y", " ": "z", None: None}
    assert {r.k: r.v for r in C.on_duplicate(df, "k", "o", "first").collect()} == {"a": "x", " ": "z", None: None}
    with pytest.raises(ValueError):
        C.on_duplicate(df, "k", "o", "any")
    other = spark.createDataFrame([("a", 9)], "k string, w int")
    assert sorted((r.side, r.key or "") for r in C.orphans(df, other, "k").collect()) == [("left", ""), ("left", " ")]
    assert sorted((r.k or "", r.w, r.found) for r in C.complete_left_join(df, other, "k", {"w": 0}).collect()) == [("", 0, False), (" ", 0, False), ("a", 9, True), ("a", 9, True)]
    joined, wrong = C.aligned_join(df.select("o", "k"), spark.createDataFrame([(1, "a"), (2, "b"), (5, "z")], "o int, k string"), "o", "k")
    assert [r.o for r in joined.collect()] == [1] and sorted(r.o for r in wrong.collect()) == [2, 3, 5]
    assert [tuple(r) for r in C.set_difference(df.select("k"), other.select("k")).orderBy(F.col("k").asc_nulls_first()).collect()] == [("left", None), ("left", " "), ("left", "a")]
    assert [r.selected for r in C.select_rows(df, "o", 2, 0).collect()] == [False] * 4 and [r.selected for r in C.select_rows(df, "o", 2).collect()] == [False, True, True, True]
    assert [r.k for r in C.allow_list(df, ["o"], "k", "o").orderBy("o").collect()] == ["a", "a", "#3", "#4"]
    assert C.batches(df.where("k IS NOT NULL"), ["o"], other, "k", 2).count() == 1


def test_runs_against_brute_force(small_batches):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(900), i, rng.choice("xyz")) for i in range(260)]
    df = small_batches.createDataFrame(rows, "e string, t bigint, i bigint, k string")
    by = defaultdict(list)
    for e, t, i, k in rows:
        if e is not None:
            by[e].append((t, i, k))
    want, numbers = {}, {}
    for e, v in by.items():
        v.sort()
        for n, (t, i, _) in enumerate(v):
            numbers[i] = n + 1
            start = i if n == 0 or t - v[n - 1][0] > 6 else start
            want[i] = start
    assert {r.i: r.run_start for r in R.sessions(df, "e", "t", "i", 6).collect()} == want
    assert {r.i: r.sequence for r in R.numbered(df, "e", ["t", "i"]).collect()} == numbers
    labels = {(r.e, r.k): r.label_no for r in R.first_seen_relabel(df.where("e IS NOT NULL"), "e", "k", "i").collect()}
    for e in by:
        order = list(dict.fromkeys(k for _, k in sorted((i, k) for _, i, k in by[e])))
        assert {k: labels[e, k] for k in order} == {k: n for n, k in enumerate(order)}
    assert R.sessions(df.limit(0), "e", "t", "i", 6).collect() == []


def test_merge_adjacent(spark):
    rows = [("a", 0, 1, "x", 10), ("a", 12, 2, "x", 13), ("a", 14, 3, "y", 20), ("a", 15, 4, "x", 16), ("a", 40, 5, "x", 41)]
    df = spark.createDataFrame(rows, "e string, s bigint, i bigint, k string, t bigint")
    assert sorted((r.k, r.s, r.t) for r in R.merge_adjacent(df, "e", "k", "i", "s", "t", 3).collect()) == [("x", 0, 13), ("x", 15, 16), ("x", 40, 41), ("y", 14, 20)]


def test_greedy(spark):
    obs = spark.createDataFrame([("s", t, i, x, 0.5, 0.8, 1.0) for i, (t, x) in enumerate([(0.0, "hello world"), (1.0, "hello worlds"), (1.0, "other"), (2.0, "hello world"), (9.0, "hello world")])], "e string, t double, pos bigint, text string, cx double, cy double, confidence double")
    assert sorted((r.start_sec, r.end_sec, r.text, r.observations) for r in greedy.merge_captions(obs, "e", 1.0).collect()) == [(0.0, 3.0, "hello worlds", 3), (1.0, 2.0, "other", 1), (9.0, 10.0, "hello world", 1)]
    a = spark.createDataFrame([("s", 1.0, 1), ("s", 2.0, 2), ("s", 50.0, 3)], "e string, t double, pos bigint")
    b = spark.createDataFrame([("s", 1.9, 1), ("s", 2.1, 2), ("s", 60.0, 3)], "e string, t double, pos bigint")
    assert sorted((r.left_pos, r.right_pos) for r in greedy.match_in_order(a, b, "e").collect()) == [(1, 1), (2, 2)]
    n = spark.createDataFrame([("s", 5, 1.0, 1, 0.5), ("s", 5, 1.2, 2, 0.9), ("s", 5, 1.4, 3, 0.1), ("s", 6, 1.0, 4, 0.1)], "e string, v int, t double, pos bigint, c double")
    assert sorted(r.pos for r in greedy.suppress_near(n, "e", "v", "t", ["c"]).collect()) == [2, 4]
    g = spark.createDataFrame([("s", float(i), i, "x", i + 0.9) for i in range(12)], "e string, start_sec double, pos bigint, speaker string, end_sec double")
    assert [r.group_no for r in greedy.span_capped_groups(g, "e").orderBy("pos").collect()] == [0] * 8 + [1] * 4
    t = spark.createDataFrame([("s", 1, "abc def"), ("s", 2, "abc"), ("s", 3, "xyz"), ("s", 4, None), ("r", 1, "abc")], "e string, pos int, text string")
    assert sorted((r.e, r.pos) for r in greedy.keep_uncovered(t, ["e"], "text").collect()) == [("r", 1), ("s", 1), ("s", 3)]


def test_matching(spark):
    items = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 50, 60)], "e string, id int, l_start int, l_end int")
    turns = spark.createDataFrame([("s", 1, "A", 0, 5), ("s", 2, "B", 5, 10), ("s", 3, "C", 9, 20)], "e string, pos int, who string, r_start int, r_end int")
    assert {r.id: r.who for r in M.largest_overlap(items, turns, ["e"], "id", "who", 7, "?").collect()} == {1: "A", 2: "?"}
    assert {r.id: r.vetoed_by for r in M.veto(items, turns.drop("who"), ["e"], "id", 7).collect()} == {1: 1, 2: None}
    assert sorted(r.id for r in M.veto_with_rescue(items, turns.drop("who", "pos"), turns.where("pos = 9").drop("who", "pos"), ["e"], "id", 7).collect()) == [2]
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.85), (2, "a", 0.6), (3, "a", 0.5)], "i int, c string, s double")
    assert {r.i: r.c for r in M.winner_with_margin(scores, "i", "c", "s").collect()} == {1: None, 2: "a", 3: None}
    claims = spark.createDataFrame([("s", ["p", "q"]), ("t", ["p"])], "g string, required array<string>")
    ev = spark.createDataFrame([("s", "p")], "g string, pair string")
    assert {r.g: r.missing for r in M.supported_claims(claims, ev, "g").collect()} == {"s": ["q"], "t": ["p"]}
    box = lambda a: (a, a, a + 0.2, a + 0.2)
    issues = spark.createDataFrame([("s", 1, 1.0, 2.0, 1.5, box(0.1)), ("s", 2, 1.0, 2.0, 9.0, None), ("s", 3, 1.0, 2.0, None, box(0.7))], "e string, i int, start_sec double, end_sec double, keyframe_sec double, bx struct<x1:double,y1:double,x2:double,y2:double>")
    calls = spark.createDataFrame([("s", 2.2, 3.0, 2.4, box(0.2))], "e string, c_start double, c_end double, c_at double, cx struct<x1:double,y1:double,x2:double,y2:double>")
    assert [r.i for r in M.supported_by_calls(issues, calls, "e", 0.25, 1.0).collect()] == [1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_reports(spark):
    df = spark.createDataFrame([("s", True, True), ("s", True, False), ("t", False, False), ("t", None, True)], "g string, p boolean, a boolean")
    assert {r.g: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in X.precision_recall(df, F.col("p"), F.col("a"), ["g"]).collect()} == {"s": (1, 1, 0, 0.5, 1.0), "t": (0, 0, 0, None, None)}
    t = spark.createDataFrame([("g", "a", 2.0), ("g", "b", 1.0), ("g", "a", 1.0), ("h", "z", 1.0)], "g string, i string, s double")
    assert {r.g: (r.i, r.score, r.share, r.margin) for r in X.top_with_margin(t, "g", "i", "s").collect()} == {"g": ("a", 3.0, 0.75, 2.0), "h": ("z", 1.0, 1.0, 1.0)}
    v = spark.createDataFrame([("b", 1, [1.0, 0.0]), ("b", 2, [0.0, 2.0]), ("b", 3, [1.0, 1.0])], "b string, i int, v array<double>")
    q = vectors.block_quality(v, "b", "i", "v").first()
    assert (q.members, q.pairs) == (3, 3) and abs(q.mean_cosine - (2**0.5) / 3) < 1e-9
    assert [(r.left_id, r.right_id) for r in vectors.block_pairs(v, "b", "i", "v", 0.5).orderBy("left_id").collect()] == [(1, 3), (2, 3)]


def test_files(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes('﻿序号,a,b,c,d,e\r\n1,"line\nbreak","say ""x""",,,\r\n'.encode())
    df = files.read_csv(spark, str(p), files.SAMPLE_COLUMNS)
    assert df.collect()[0][:3] == ("1", "line\nbreak", 'say "x"') and df.select(files.cell(df, "nope").alias("n")).first().n == ""
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), ("a",))
    j = tmp_path / "x.jsonl"
    j.write_text('{"sample_id": "a", "n": 1}\n\n{bad\n{"sample_id": "b"}\n')
    good, bad = files.read_jsonl(spark, str(j), "sample_id string, n int")
    assert sorted((r.sample_id, r.n) for r in good.collect()) == [("a", 1), ("b", None)] and [r.value for r in bad.collect()] == ["{bad"]
    for s in ("sample_1", "sample_2"):
        (tmp_path / "pk" / s).mkdir(parents=True)
        (tmp_path / "pk" / s / "input.json").write_text(json.dumps({"id": s}, indent=1), encoding="utf-8-sig")
        (tmp_path / "pk" / s / "gt.json").write_text("[nope\n")
    packs = files.read_packages(spark, str(tmp_path / "pk"))
    assert sorted((r.sample, r.document, r.i) for r in packs.select("sample", "document", F.try_variant_get("content", "$.id", "string").alias("i")).collect()) == [("sample_1", "gt", None), ("sample_1", "input", "sample_1"), ("sample_2", "gt", None), ("sample_2", "input", "sample_2")]
    (tmp_path / "side").mkdir()
    (tmp_path / "side" / "v1.txt").write_text("two\nlines")
    assert [tuple(r) for r in files.read_sidecars(spark, str(tmp_path / "side")).collect()] == [("v1", "two\nlines")]
    assert files.leaks(good, "sample_id", ["A"]).count() == 1


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (2, "b", None)], "user_id long, kind string, value double")
    out = str(tmp_path / "out")
    sinks.commit_staged(df, out, "json", ["kind"])
    assert spark.read.json(out).count() == 3
    with pytest.raises(FileExistsError):
        sinks.commit_staged(df, out, "json")
    log = str(tmp_path / "log")
    assert [sinks.append_new(df, log, "user_id"), sinks.append_new(df, log, "user_id")] == [2, 0]
    rec = {r.import_key: json.loads(r.record) for r in sinks.import_records(df, "kind", "user_id").collect()}
    assert rec == {"a:1": {"fields": {"user_id": 1, "kind": "a", "value": 1.5}}, "b:2": {"fields": {"user_id": 2, "kind": "b"}}}
    assert sinks.report(df.limit(1), "%s=%s", ["kind", "value"]).first().line == "a=1.5"
    src = str(tmp_path / "src")
    df.write.parquet(src)
    ST.append_stream(ST.file_stream(spark, src, df, 100), str(tmp_path / "log2"), "user_id", str(tmp_path / "c2"))
    assert spark.read.json(str(tmp_path / "log2")).count() == 2
    tops = ST.drain(ST.running_maximum(ST.file_stream(spark, src, df, 100), "user_id", "value"), str(tmp_path / "tops"), str(tmp_path / "c1"))
    assert [tuple(r) for r in tops.collect()] == [(1, 1.5)]
