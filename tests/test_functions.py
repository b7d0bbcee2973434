from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G, jsonops as J, similarity as S, textops as T
from tessera.plans import rules


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text(spark):
    df = spark.createDataFrame([("ß Ｆull-width １２ ﬁ é!",), ("",), (None,)], "t string")
    rows = df.select(T.fold_text(F.col("t")), T.folded_with_offsets(F.col("t")), T.compact_text(F.col("t")), T.language_family(F.col("t"))).collect()
    assert rows[0][0] == "ßFullwidth12fié" and rows[0][1].text == "ssfullwidth12fié" and rows[0][1].offsets[:4] == [0, 0, 2, 3]
    assert rows[0][3] == "latin" and rows[1][0] == "" and rows[2][0] is None and rows[2][3] is None and rows[1][3] == "unknown"
    r = one(
        spark, T.strip_event_tags(F.lit("<|BGM|> ♪ hi,  there! ")), T.event_tags(F.lit("<|A|>x<|b|><|a|>")), T.join_tokens(F.array(*map(F.lit, ["a", "b", "，", "c", "中", "1"]))),
        T.clause_at(F.lit("one。two three。four"), F.lit(4), F.lit(7)), T.quoted_spans(F.lit('a "x" “y” "x" 「 」')), T.canonical_number(F.lit("00,1200")), T.canonical_number(F.lit("0000")),
        T.last_time_range(F.lit("1s-2s then 3.5 s 至 4 秒 end")), T.contains_any(F.lit("a.b"), ["."]), T.contains_any(F.lit("ab"), ["."]), T.surface_tokens(F.lit("it's 3.5，好")),
        T.is_substantial_speech(F.lit("um the big lantern"), ["um"]), T.is_substantial_speech(F.lit("um um"), ["um"]),
    )
    assert list(r)[:7] == ["hi, there", ["a", "b"], "a b，c中1", "two three", ["x", "y"], "1200", None]
    assert (r[7].start_sec, r[7].end_sec, r[8], r[9], r[10], r[11], r[12]) == (3.5, 4.0, True, False, ["it's", "3.5", "，", "好"], True, False)


def test_json(spark):
    cells = ["[]", '[{"a":1}]', '[1]', "{}", '"x"', "1", "null", "nope", None, '[{"a":1},null]']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.select(J.json_kind(F.col("c")), J.is_object_array(F.col("c")), J.string_array(F.col("c"))).collect()
    assert [g[0] for g in got] == ["array", "array", "array", "object", "string", "number", "null", None, None, "array"]
    assert [g[1] for g in got] == [True, True] + [False] * 8
    r = one(
        spark, J.string_array(F.lit('[" a ", "", null, "b"]')), J.canonical_json({"b": F.lit(1), "a": F.lit("x")}), J.object_slice(F.lit('say {"a": {}} end')), J.array_slice(F.lit("x [1, [2]] y")),
        J.sorted_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))), J.merge_maps(F.create_map(F.lit("s"), F.lit("1")), F.create_map(F.lit("s"), F.lit("2"))),
        J.content_text(F.parse_json(F.lit('["a", {"text": "b"}, {"x": 1}]'))), F.length(J.cache_key(F.lit("t"), {"a": F.lit(1)})), J.object_array(F.lit('[{"a": 1}, {}]'), "struct<a:int>"), J.object_array(F.lit('{"a": 1}'), "struct<a:int>"),
    )
    assert r[0] == ["a", "b"] and r[1] == '{"a":"x","b":1}' and r[2] == '{"a": {}}' and r[3] == "[1, [2]]" and list(r[4]) == ["a", "b"] and r[5] == {"s": "2"} and r[6] == "a\nb" and r[7] == 66
    assert [x.a for x in r[8]] == [1, None] and r[9] is None


def test_geometry(spark):
    box = G.unit_box(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))
    r = one(
        spark, G.time_range(F.lit("1s - 1 s"), True), G.time_range(F.lit("1s - 1 s"), False), G.time_range(F.lit("2 - 1"), True), G.bbox_bounds(F.lit("<bbox>0.1,0.2,0.3,1.4</bbox>")),
        G.scaled_box(*map(F.lit, (100.0, 200.0, 300.0, 400.0, 1920.0, 1080.0))), G.scaled_box(*map(F.lit, (192.0, 108.0, 1920.0, 1080.0, 1920.0, 1080.0))), G.boxes_overlap(box, G.unit_box(*map(F.lit, (0.3, 0.2, 0.5, 0.4)))),
        G.finite(F.lit("nan")), G.finite(F.lit("1e3")), G.finite(F.lit("x")), G.resolution_meets(F.lit(720), F.lit(1280), F.lit(720), F.lit(1280)), G.duration_within(F.lit(9.5), F.lit(10.0), F.lit("exact")), G.duration_within(F.lit(9.4), F.lit(10.0), F.lit("minimum")),
        G.format_range(F.lit(1.0), F.lit(2.25)), G.interval_gap(F.lit(0.0), F.lit(1.0), F.lit(3.0), F.lit(4.0)),
    )
    assert (r[0].start_sec, r[1], r[2], r[3]) == (1.0, None, None, None) and (r[4].x1, r[4].y2) == (0.1, 0.4) and r[5].x2 == 1.0
    assert list(r)[6:] == [False, None, 1000.0, None, True, True, False, "1.00s - 2.25s", 2.0]
    gates = [one(spark, G.sync_gate(F.lit(c), F.lit(o)))[0] for c, o in ((3.0, 6), (3.0, 7), (2.9, 7), (9.0, 15), (9.0, -15), (3.0, -6), (None, 1))]
    assert gates == ["ok", "flagged", "unreliable", "boundary", "boundary", "ok", "unknown"]


def test_similarity(spark):
    assert S.edit_operations("kitten", "sitting") == [("substitute", 0, 0, "k", "s"), ("substitute", 4, 4, "e", "i"), ("insert", 6, 6, "", "g")]
    assert S.best_substring("abcd", "xxabXdyy") == (1, 2, 6)
    df = spark.createDataFrame([("abc", "abd"), ("abc", "abc"), ("ab", "abc"), ("abc", "ab"), (None, "a"), ("", "")], "a string, b string")
    rows = df.select(S.difference_kind(S.edits(F.col("a"), F.col("b"))), S.same_caption(F.col("a"), F.col("b")), S.semi_global(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == ["wrong", "none", "extra", "missing", None, "none"]
    assert [r[1] for r in rows] == [False, True, False, False, None, True] and rows[4][2].edits is None and rows[2][2].similarity == 1.0
    g = one(spark, S.passes_anchor_gates(F.lit("abcdefghij"), F.struct(F.lit(1).alias("edits"), F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit(0.9).alias("similarity"))))
    assert g[0] is True
    long = ("ab" * 120, "ab" * 119 + "ba")
    junk = spark.createDataFrame([long], "a string, b string").select(S.block_ratio(F.col("a"), F.col("b"), True), S.block_ratio(F.col("a"), F.col("b"), False)).first()
    assert junk[0] < junk[1]


def test_rules(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "b"), (3, None)], "i int, t string")
    r = [("a", F.col("t").contains("a")), ("b", F.col("t").contains("b"))]
    rows = df.select(rules.first_match(r, "rest"), rules.all_matches(r), rules.reject_reason(r)).collect()
    assert [tuple(x) for x in rows] == [("a", ["a", "b"], None), ("b", ["b"], "a"), ("rest", [], "a")]
    assert sorted(map(tuple, rules.partition_counts(df, rules.first_match(r, "rest"), ["a", "b", "rest", "none"]).collect())) == [("a", 1), ("b", 1), ("none", 0), ("rest", 1)]
    assert [x.veto_stage for x in rules.cascade(df, r).orderBy("i").collect()] == ["a", "b", None]


@pytest.mark.parametrize("closed,nulls,want", [(True, True, [True, True, False]), (False, False, [False, False, False])])
def test_overlap_rules(spark, closed, nulls, want):
    from tessera.operators.intervals import overlaps

    df = spark.createDataFrame([(0, 1, 1, 2), (0, None, 1, 2), (0, 1, 2, 3)], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(overlaps(*map(F.col, "abcd"), closed=closed, null_is_true=nulls)).collect()] == want
