from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import mediachecks as M
from tessera.operators.roles import Cast, cast_plan, stands_there, whole_role

TABLE = "视频角色对照表：店长=【图1】；小雨=图2，老周=无\n视频场景对照表：街道=图3\n"


def lines(text):
    return [(x[1], x[2], x[3]) for x in Cast(text).lines()]


def test_declared_roles():
    c = Cast(TABLE + "@图片4为阿青，台词：@阿青 说。镜头背景图5，红衣女孩图6")
    assert c.names["图1"] == "店长" and c.names["图片2"] == "小雨" and c.names["老周"] == "老周" and c.names["图4"] == "阿青"
    assert "图5" not in c.names and c.images == {"阿青": [4], "店长": [1], "小雨": [2], "红衣女孩": [6]}
    assert whole_role("由店长始终", []) == "店长" and whole_role("与年轻的店长", ["店长", "年轻的店长"]) == "年轻的店长"


def test_rules_in_order():
    assert lines(TABLE + "台词：@小雨 “走吧”") == [("小雨", "mention", "走吧")]
    assert lines(TABLE + "店长看着小雨说：“走吧”") == [("店长", "subject", "走吧")]
    assert lines(TABLE + "主体动作：店长推着小雨急喊：“快跑”") == [("小雨", "subject", "快跑")]
    assert lines(TABLE + "主体动作：店长推着小雨说：“快跑”") == [("店长", "subject", "快跑")]
    assert lines(TABLE + "旁边的店长：“来了”") == [("店长", "known", "来了")]
    assert lines(TABLE + "路人：“来了”") == []
    assert lines("导演（微笑）说：“再来一遍”") == [("导演", "named", "再来一遍")]
    assert lines("低声道：“再来”") == [] and lines("墙上写着“出口”") == [] and lines("") == []


def test_loose_lines_need_a_declared_role():
    assert lines(TABLE + "店长说：我们明天再来") == [("店长", "subject", "我们明天再来")]
    assert lines("突然激动跑进来大喊：快走") == []


def test_scope_times_and_images(spark):
    texts = [TABLE + "0s-2s 店长说：“一”\n3秒至2秒 小雨说：“二” 不得有其他台词", "店长说：“一” 不要有其他台词，例如", "店长说：“一”", "无", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("plan", cast_plan(F.col("t")))
    got = {r.k: r.plan for r in df.collect()}
    assert [got[k].scope for k in range(6)] == ["closed", "partial", "partial", "none", "none", "none"]
    one, two = got[0].turns
    assert (one.start_sec, one.end_sec, one.images, two.start_sec, two.images, got[0].roles) == (0.0, 2.0, [1], None, [2], ["店长", "小雨"])
    kept = df.select("t", F.explode("plan.turns").alias("x"))
    assert {r[0] for r in kept.select(stands_there(F.col("t"), F.col("x"))).collect()} == {True}
    assert {r[0] for r in kept.select(stands_there(F.lit("other"), F.col("x"))).collect()} == {False}


def test_constraints():
    found = lambda t: [c[:6] for c in M._stated("prompt", t)]
    assert found("输出要求1080P，不低于；") == [("resolution", "minimum", 1080, 1920, None, None)]
    assert found("不需要4k画质") == [] and found("参考图是4k画质") == [] and found("参考图4k，生成视频达到 3840×2160") == [("resolution", "minimum", 2160, 3840, None, None)]
    assert found("至少视频总时长为10秒。生成一段5秒视频") == [("duration", "minimum", None, None, 10.0, "whole"), ("duration", "exact", None, None, 5.0, "made")]
    assert found("镜头1：持续3秒") == [("duration", "exact", None, None, 3.0, "shot")] and found("镜头1：3秒 镜头2：4秒") == []


def test_checks(spark):
    rows = [(1, "输出1080p，总时长10秒", "成片1080p", 1080, 1920, 12.0), (2, "走路", None, 0, 0, None), (3, "输出4k，视频时长为8秒最多", None, None, None, 8.3)]
    df = spark.createDataFrame(rows, "k int, prompt string, feedback string, w int, h int, d double")
    out = M.check_constraints(df, "k", {"prompt": F.col("prompt"), "feedback": F.col("feedback")}, F.col("w"), F.col("h"), F.col("d")).collect()
    assert sorted((r.k, r.kind or "", r.status) for r in out) == [(1, "duration", "missed"), (1, "resolution", "met"), (2, "", "not_requested"), (3, "duration", "met"), (3, "resolution", "not_evaluable")]


def test_gate(spark):
    cand = spark.createDataFrame([(i, i != 4) for i in range(1, 6)], "k int, ran boolean")
    settled = spark.createDataFrame([(9, True)], "k int, ran boolean")
    verdicts = spark.createDataFrame([(1, 1, "supported"), (1, 2, "contradicted"), (2, 1, "contradicted"), (3, 1, "perhaps"), (4, 1, "supported")], "k int, pos int, verdict string")
    got = {r.k: r.outcome for r in M.gated_by_verdicts(cand, settled, verdicts, "k", F.col("ran")).collect()}
    assert got == {9: "settled", 1: "supported", 2: "contradicted", 3: "inconclusive", 4: "not_verified", 5: "inconclusive"}
