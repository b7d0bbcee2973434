from __future__ import annotations

import json

import pytest

from tessera.operators.packed import resolve, skeleton, split_packed

CASES = {
    "/a/b.png": ["/a/b.png"],
    "a.png；b.png、 c.png": ["a.png", "b.png", "c.png"],
    " a.png | b.png\r\nc.png\t; ;": ["a.png", "b.png", "c.png"],
    '"a, b.png";c.png': ["a, b.png", "c.png"],
    "“x；y.png”|z.png": ["x；y.png", "z.png"],
    '"the ""old"" one.png","b.png"': ['the "old" one.png', "b.png"],
    "['it.png', \"it's.png\"]": ["it.png", "it's.png"],
    "['a\\'b.png']": ["a'b.png"],
    '["a.png", null, "", " b.png "]': ["a.png", "b.png"],
    json.dumps(["灯、笼.png", 'q"q\\.png', "a/b"]): ["灯、笼.png", 'q"q\\.png', "a/b"],
    json.dumps(json.dumps(["灯.png", "b, c.png"])): ["灯.png", "b, c.png"],
    json.dumps(json.dumps(["灯.png", 'b"c'], ensure_ascii=False, indent=1), ensure_ascii=False): ["灯.png", 'b"c'],
    '"[""a.png"", ""b.png""]"': ["a.png", "b.png"],
    '["\\/mnt\\/a.png"]': ["/mnt/a.png"],
    "[]": [], '[""]': [], "": [], "  ": [], '"': [], ";;": [], "null": [],
    '"open, b.png': ["open", "b.png"],
    "a.png a.png": ["a.png", "a.png"],
    "[a.png, b.png]": ["a.png", "b.png"],
}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_cells(spark, limit):
    rows = [(i, c, "x") for i, c in enumerate(CASES)] + [(500, None, "x")]
    df = spark.createDataFrame(rows + rows[:3], "row_index bigint, cell string, pos string")
    got: dict[int, list] = {}
    for r in split_packed(df, "row_index", "cell", limit).collect():
        got.setdefault(r.row_index, []).append((r.pos, r.ref_value))
    for i, (cell, want) in enumerate(CASES.items()):
        assert sorted(got.get(i, [])) == list(enumerate(want, 1)), cell
    assert 500 not in got


def test_long_and_empty(spark):
    long = ";".join(f"/p/{i}.png" for i in range(3000))
    df = spark.createDataFrame([(1, long)], "row_index bigint, cell string")
    assert [r.ref_value for r in split_packed(df, "row_index", "cell").orderBy("pos").collect()] == long.split(";")
    assert split_packed(df.limit(0), "row_index", "cell").collect() == []


def test_rule_positions():
    assert resolve('["x","x"]') == [(2, 3, 1), (6, 7, 1)]


def test_skeletons_follow_the_quoting_only(spark):
    """How many values, dividers and escapes a run holds changes no skeleton."""
    cells = ['["a, b.png","c"]', '["a","c; d, e"]', '["a\\u706f\\u7b3c.png","c"]', '["a","b.png"]']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r[0] for r in df.select(skeleton(df.c)).collect()} == {'["x","x"]'}
