from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import validation as V
from tessera.operators import evidence as E
from tessera.plans import sampling as S

ISSUE = "g string, pos int, localizable string, confidence string, description string, issue_type string, time_range string, keyframe_sec string, bbox string"


def issues(spark, rows):
    return spark.createDataFrame([(g, p, "是", "高", d, t, r, "", "") for g, p, d, t, r in rows], ISSUE)


def test_validation(spark):
    df = spark.createDataFrame([(1, "test", "", '{"a": [{"b": " "}]}'), (2, None, None, '{"a": [{"b": 0}]}'), (3, "ok", "test", "x"), (4, "1", "测试", None)], "i int, prompt string, feedback string, j string")
    got = {r.i: r for r in df.select("i", V.only_junk([F.col("prompt"), F.col("feedback")], ["test", "测试"], r"\d+").alias("junk"), V.has_content(F.col("j")).alias("filled"), V.json_or_error(F.col("j"), "j", F.col("i"))["error"].alias("e"), V.any_alias_filled(df, ["FEEDBACK", "nope"]).alias("fb"), V.violations([("long", F.length("prompt") > 2)]).alias("v")).collect()}
    assert [got[i].junk for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert [got[i].filled for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert got[3].e == "j: no JSON in row 3" and got[4].e is None and got[1].e is None
    assert [got[i].fb for i in (1, 2, 3, 4)] == [False, False, True, True] and got[2].v == ["long"]
    states = spark.createDataFrame([(True, None, None), (False, "ok", ""), (None, None, None), (None, "OK", " "), (True, "ok", "boom")], "s boolean, t string, e string")
    assert [r[0] for r in states.select(V.run_state(F.col("s"), F.col("t"), F.col("e"))).collect()] == ["ok", "failed", "unknown", "ok", "failed"]
    row = spark.sql("SELECT array(named_struct('speaker','a','t',1)) AS x, 'say no sharp 1080p' AS q").select(V.mask_nested(F.col("x"), "speaker", F.lit(None).cast("boolean")).alias("x"), V.required_clause(F.col("q"), "1080p", ["no"]).alias("r"), V.around(F.col("q"), F.lit("sharp"), 3, 3).alias("w"), V.clean_strings(F.array(F.lit(" a "), F.lit(""), F.lit("a")), True).alias("c")).first()
    assert (row.x[0].speaker, row.r, row.w, row.c) == (None, False, "no sharp 10", ["a"])


def test_candidates_and_verdicts(spark):
    a = issues(spark, [("g", 1, "x", "t", ""), ("g", 2, "y", "t", ""), ("g", 3, "y", "t", ""), ("g", 4, "z", "t", "")])
    assert sorted((r.pos, r.candidate_id) for r in E.new_candidates(a, issues(spark, [("g", 9, "x", "t", "")]), "g").collect()) == [(2, 1), (3, 2), (4, 3)]
    assert sorted(r.pos for r in E.exact_first(a, "g").collect()) == [1, 2, 4]
    v = spark.createDataFrame([(1, 1, "supported", "r" * 900), (1, 2, "contradicted", "x"), (2, 1, "maybe", None)], "pos int, vpos int, verdict string, reason string").withColumnRenamed("pos", "k").withColumnRenamed("vpos", "pos")
    out = E.verdicts_for(spark.createDataFrame([(1,), (2,), (3,)], "k int"), v, "k")
    got = {r.k: (r.verdict, len(r.reason or "")) for r in out.collect()}
    assert got == {1: ("supported", 500), 2: ("inconclusive", 0), 3: ("inconclusive", 0)}
    assert sorted(r.pos for r in E.apply_verdicts(a, out.withColumnRenamed("k", "pos"), "pos").collect()) == [1, 4]


def test_coverage(spark):
    final = issues(spark, [("g", 1, "灯笼颜色不对，应为红色", "颜色", "1s - 2s"), ("h", 1, "abc", "颜色", "1s - 2s")])
    need = issues(spark, [("g", 2, "灯笼颜色不对", "颜色", "2s - 3s"), ("g", 3, "灯笼颜色不对", "颜色", "5s - 6s"), ("g", 4, "灯笼颜色不对", "声音", "1s - 2s"), ("g", 5, "灯笼颜色不对，应为红", "颜色", "")])
    assert sorted((r.g, r.pos, r.origin) for r in E.preserve(final, need, "g").collect()) == [("g", 1, "final"), ("g", 3, "required"), ("g", 4, "required"), ("h", 1, "final")]
    rows = spark.createDataFrame([("g", 1, ["a"]), ("g", 2, ["a", "b"]), ("g", 3, ["b"]), ("g", 4, ["a", "c"])], "g string, pos int, parts array<string>")
    assert sorted(r.pos for r in E.drop_jointly_covered(rows, "g").collect()) == [1, 3, 4]


def test_check_status_is_never_a_false_negative(spark):
    res = spark.createDataFrame([("s", "ocr", "ok", "weak", 0), ("s", "asr", "failed", None, 3), ("t", "asr", "not_applicable", None, 0), ("u", "ocr", "ok", "strong", 2)], "g string, tool string, status string, level string, issues int")
    dep = spark.createDataFrame([("text", "ocr"), ("text", "asr"), ("voice", "asr")], "check_name string, tool string")
    got = {(r.g, r.check_name): (r.status, r.decision, r.limitations) for r in E.check_status(res, dep, "g", ["weak", "strong"]).collect()}
    assert got[("s", "text")] == ("ok", "not_detected", ["asr"]) and got[("s", "voice")] == ("failed", "not_evaluable", ["asr"])
    assert got[("t", "text")][1] == "not_evaluable" and got[("u", "text")][1] == "detected" and len(got) == 6


def test_binding_tokens_numbers(spark):
    r = spark.createDataFrame([("s", "A", "0", 2.0, 1), ("s", "A", "1", 0.5, 2), ("s", "B", "0", 1.2, 3), ("s", "C", "2", 0.3, 4)], "g string, role string, speaker string, weight double, turn int")
    got = {x.role: (x.speaker, x.reasons) for x in E.binding_candidates(r, "g").collect()}
    assert got == {"A": ("0", ["shared_speaker"]), "B": ("0", ["shared_speaker"]), "C": ("2", ["weight", "lead"])}
    toks = [("s", i, t, a, a + 0.1, k) for i, (t, a, k) in enumerate([("Hello", 0.0, "x"), ("world", 0.2, "x"), ("!", 0.9, "x"), ("再", 1.1, "x"), ("见", 1.2, "x"), ("...", 2.0, "y"), ("ok", 2.5, "y")])]
    df = spark.createDataFrame(toks, "g string, pos bigint, token string, start_sec double, end_sec double, speaker string")
    assert sorted((x.start_sec, x.text) for x in E.token_segments(df, "g").collect()) == [(0.0, "Hello world!"), (1.1, "再见"), (2.5, "ok")]
    seg = spark.createDataFrame([(1, 0.0, 10.0, "ab12cd3456")], "k int, start_sec double, end_sec double, text string")
    assert [(x.ordinal, x.digits, x.at_sec) for x in E.number_events(seg, "k").collect()] == [(1, "12", 3.0), (2, "3456", 8.0)]


def test_plans(spark):
    clips = spark.createDataFrame([("a", 2.0), ("b", 100.0), ("c", None)], "clip string, d double")
    plan = S.frame_plan(clips, "clip", "d", 2.0, 10).toPandas()
    assert plan.groupby("clip").size().to_dict() == {"a": 4, "b": 10} and plan[plan["clip"] == "b"].at_sec.max() == 90.0
    assert S.capacity_matrix(spark, 30.0, [0.5, 2.0], [16, 60]).where("fits").count() == 3
    t = spark.createDataFrame([("v", 2, 4.0, 1.0), ("v", 3, 6.0, 2.0), ("w", 1, None, None)], "v string, offset_frames int, confidence double, min_dist double")
    assert {r.v: (r.offset, r.quality) for r in S.sync_summary(t, "v").collect()} == {"v": (2, "good"), "w": (1, None)}
    r = spark.range(1).select(S.contact_range(F.lit(-1.0), F.lit(99.0), F.lit(10.0), 2.0).alias("c"), S.batch_of(F.lit(7), 6).alias("b")).first()
    assert (r.c.start_sec, r.c.end_sec, r.c.frames, r.c.columns, r.c.rows, r.b) == (0.0, 10.0, 20, 5, 4, 1)


def test_unpivot(spark):
    df = spark.createDataFrame([("s", "ok", None, "failed", "boom")], "g string, a_status string, a_error string, b_status string, b_error string")
    assert sorted(map(tuple, E.unpivot_stages(df, "g", ["a", "b"]).collect())) == [("s", "a", "ok", None), ("s", "b", "failed", "boom")]


