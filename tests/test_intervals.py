from __future__ import annotations

import random
from collections import defaultdict

from tessera.operators.intervals import overlap_join, periods_and_gaps


def brute(rows, max_gap):
    by = defaultdict(list)
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by[k].append((s, e))
    out = set()
    for k, v in by.items():
        periods = []
        for s, e in sorted(v):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out |= {(k, "period", s, e) for s, e in periods}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


def test_periods_random(small_batches):
    rng = random.Random(4)
    for reach in (200, 2000, 8000):
        rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(reach)) for _ in range(300)]
        rows = [(k, s, s + rng.choice([-1, 0, 1, 5, 20, 200])) for k, s in rows]
        df = small_batches.createDataFrame(rows, "k string, s bigint, e bigint")
        assert {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", 50).collect()} == brute(rows, 50)


def test_periods_edges(spark):
    df = spark.createDataFrame(
        [("a", 0, 10, "x"), ("a", 10, 20, "x"), ("a", 2, 3, None), ("a", 2, 3, None), ("a", None, 5, "x"), ("a", 5, None, "x"), (None, 0, 9, "x"), ("b", -5, 2**60, "x"), ("a", 1000, 1001, "")],
        "k string, s bigint, e bigint, key string",
    )
    assert {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", None).collect()} == {("a", "period", 0, 20), ("a", "gap", 20, 1000), ("a", "period", 1000, 1001), ("b", "period", -5, 2**60)}
    assert periods_and_gaps(df.limit(0), ["k"], "s", "e").collect() == []


def test_overlap_join_once(spark):
    rng = random.Random(9)
    mk = lambda n: [(rng.choice("xy"), i, (s := rng.randrange(100)), s + rng.randrange(0, 30)) for i in range(n)]
    a, b = mk(60), mk(60)
    left = spark.createDataFrame(a, "k string, i int, l_start int, l_end int")
    right = spark.createDataFrame(b, "k string, j int, r_start int, r_end int")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ["k"], 7).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))


def test_overlaps_with_wild_ends(spark):
    """Lengths of any size against brute force; a wild end makes few copies."""
    rng = random.Random(12)
    side = lambda: [(rng.choice("ab"), i, s := rng.randrange(3000), s + rng.choice([0, 1, 5, 40, 700, 10**5, 10**9, 10**12])) for i in range(120)]
    left, right = side(), side()
    a = spark.createDataFrame(left, "e string, i int, l_start bigint, l_end bigint")
    b = spark.createDataFrame(right, "e string, j int, r_start bigint, r_end bigint")
    want = {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])}
    got = [(r.i, r.j) for r in overlap_join(a, b, ["e"], 10).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = a.where("l_end - l_start < 100")
    assert {(r.i, r.j) for r in overlap_join(few, b.where("r_end - r_start < 100"), ["e"], 10).collect()} == {(i, j) for i, j in want if left[i][3] - left[i][2] < 100 and right[j][3] - right[j][2] < 100}
    assert overlap_join(a.limit(0), b, ["e"], 10).collect() == []
