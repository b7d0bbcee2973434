from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.similarity import best_substring
from tessera.operators import dialogue as D
from tessera.plans.registry import Stages


def test_turns():
    text = "1s-3s 店长说：“走吧。”随后导演：“再来一遍” 2s - 4.5 s The host says, \"hello there\"。旁边写着“出口”"
    got = [(t[1], t[2], t[5], t[6]) for t in D.mine_turns(text)]
    assert got == [("店长", "走吧。", 1.0, 3.0), ("导演", "再来一遍", 1.0, 3.0), ("host", "hello there", 2.0, 4.5), (None, "出口", 2.0, 4.5)]
    assert all(text[t[3] : t[4]].strip() == t[2] for t in D.mine_turns(text))
    assert D.mine_turns(None) == [] and D.mine_turns("") == []


def test_plan_scope(spark):
    df = spark.createDataFrame([("a",), ("他说：“好”",), ("他说：“好”，没有其他台词",), (None,)], "t string")
    assert [r[0].scope for r in df.select(D.speech_plan(F.col("t"))).collect()] == ["none", "partial", "closed", "none"]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "1080p, at least 5 s，不超过10秒 720p"), (2, "不要1080p，时长为8秒"), (3, None), (4, "")], "k int, t string")
    got = sorted((r.k, r.kind, r["mode"], r.value) for r in D.media_constraints(df, "k", "t").collect())
    assert got == [(1, "duration", "maximum", 10.0), (1, "duration", "minimum", 5.0), (1, "resolution", "exact", 1080.0), (2, "duration", "exact", 8.0)]


def test_screen_loses_nothing(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        target = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 40)))
        query = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        rows.append((query, target, best_substring(query, target)[0]))
    df = spark.createDataFrame(rows, "q string, t string, e int")
    assert df.where((F.col("e") <= 2) & (F.col("e") < F.length("q")) & (F.length("q") >= 3) & ~D.may_hold(F.col("q"), F.col("t"), 2)).count() == 0


def test_anchors_and_decisions(spark):
    seg = spark.createDataFrame([("s", 1, "把灯笼放在地上"), ("s", 2, "把灯笼放到地上"), ("s", 3, "完全不同的话语"), ("s", 4, "灯")], "e string, i int, text string")
    prompts = spark.createDataFrame([("s", "导演把灯笼放在地上，然后离开")], "e string, prompt string")
    assert {r.i: r.edits for r in D.anchors(seg, prompts, "e", "i").collect()} == {1: 0, 2: 1}
    df = spark.createDataFrame([(-1.0, -0.2, None), (-0.2, -1.0, None), (-1.0, -0.9, False), (-1.0, 0.0, True), (None, 1.0, None)], "o double, x double, h boolean")
    assert [r[0] for r in df.select(D.likelihood_decision(F.col("o"), F.col("x"), F.col("h"))).collect()] == ["expected_preferred", "observed_preferred", "ambiguous", "homophone", "failed"]


def test_registry(spark):
    st = Stages()
    st.register("n", lambda k: spark.range(k))
    st.register("bad", lambda: 1 / 0)
    with pytest.raises(ValueError):
        st.register("n", lambda: None)
    assert st.run("n", k=3).count() == 3 and st.run("n", k=3) is st.run("n", k=3) and st.run("bad") is None
    st.preload("ocr", spark.range(1), sample="a")
    assert st.run("ocr", sample="a").count() == 1
    assert [(r.stage, r.cache_status, r.status) for r in st.trace(spark).orderBy("sequence").collect()][:4] == [("n", "miss", "ok"), ("n", "hit", "ok"), ("n", "hit", "ok"), ("bad", "miss", "failed")]
