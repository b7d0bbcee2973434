from __future__ import annotations

import random

from tessera.llm.nearest import nearest_in_time

SUB, SEG = "sub_id bigint, sample_id string, start_sec double, end_sec double, seg_id string", "seg_id bigint, sample_id string, start_sec double, end_sec double"


def test_random_and_edges(spark):
    rng = random.Random(2)
    at = lambda: rng.choice([None, float("nan"), *[rng.randrange(9000) / 1000 for _ in range(12)]])
    subs = [(i, rng.choice(["a", "b", None]), s := at(), None if s is None else s + rng.choice([-0.1, 0.0, 0.3, 2.0]), "x") for i in range(150)]
    segs = [(i, rng.choice(["a", "b", None]), at(), None) for i in range(150)]
    got = {(r.sub_id, r.seg_id) for r in nearest_in_time(spark.createDataFrame(subs + subs[:9], SUB), spark.createDataFrame(segs + segs[:9], SEG), "sample_id", "sub_id", "seg_id").collect()}
    want = set()
    for sid, clip, s, e, _ in subs:
        if clip is None or s is None or s != s or e < s:
            continue
        near = [(abs(round(t * 1000) - round(s * 1000)), t, g) for g, c, t, _ in segs if c == clip and t is not None and t == t and round(t * 1000) < round(e * 1000)]
        near = [x for x in near if x[0] <= 800]
        if near:
            want.add((sid, min(near)[2]))
    assert got == want and got
    empty = spark.createDataFrame([], SUB)
    assert nearest_in_time(empty, spark.createDataFrame(segs, SEG), "sample_id", "sub_id", "seg_id").collect() == []
