from __future__ import annotations

from tessera.functions.similarity import best_substring
from tessera.operators.dialogue import prompt_candidates

SCHEMA = "e string, i bigint, start_sec double, end_sec double, speaker string, text string"


def _run(spark, rows, prompt, **kw):
    seg = spark.createDataFrame([("s", *r) for r in rows], SCHEMA)
    got = prompt_candidates(seg, spark.createDataFrame([("s", prompt)], "e string, prompt string"), "e", "i", **kw)
    return {(r.first_seg, r.last_seg): r for r in got.collect()}


def test_windows_for_what_is_left(spark):
    rows = [(1, 0.0, 1.0, "a", "把灯笼放在地上"), (2, 1.2, 2.0, "a", "然后慢"), (3, 2.1, 3.0, None, "慢离开"), (4, 9.0, 9.5, "b", "离开"), (5, 20.0, 21.0, "b", "完全不同的话语"), (6, None, 1.0, "b", "把灯笼放在地上")]
    got = _run(spark, rows, "导演把灯笼放在桌上，然后慢慢离开。")
    assert {k: r.status for k, r in got.items()} == {(1, 1): "candidate", (2, 3): "matched"}
    assert [(d.kind, d.observed, d.expected) for d in got[1, 1].differences] == [("replace", "地", "桌")]


def test_known_differences_and_cues(spark):
    got = _run(spark, [(1, 0.0, 1.0, "a", "把灯笼放在地上"), (2, 1.1, 1.2, "a", "嗯"), (3, 8.0, 9.0, "b", "我们明天再来吧")], "导演把灯笼放在桌上。导演问：我们明天再来吧")
    assert {k: r.status for k, r in got.items()} == {(1, 1): "candidate", (3, 3): "matched"}
    cue = _run(spark, [(3, 8.0, 9.0, "b", "到我们明天再来吧")], "导演道：我们明天再来吧")
    assert cue[3, 3].status == "cue"


def test_only_the_best_are_candidates(spark):
    rows = [(i, float(10 * i), 10.0 * i + 1, "a", f"第{'甲乙丙丁'[i]}位客人慢慢走进灯火通明的屋子") for i in range(4)]
    got = _run(spark, rows, "第戊位客人慢慢走进灯火通明的屋子", most=2)
    assert sorted(r.status for r in got.values()) == ["candidate", "candidate", "further", "further"]
    assert _run(spark, rows[:0], "x") == {}


def test_equal_places():
    """The part nearest to the query's length, then the earliest."""
    assert best_substring("abc", "xabcxabc") == (0, 1, 4) and best_substring("ab", "b") == (1, 0, 1) and best_substring("ab", "xy")[0] == 2 and best_substring("a", "") == (1, 0, 0)
