"""Interval operators: continuous periods and gaps, overlap joins, nearest rows in time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.keys import packed_key, unpacked_key
from tessera.operators.carryscan import Batches, carry_scan, range_sorted


class _Islands:
    """The running state over rows sorted by (entity, start): entity, largest end so far, start of the open island."""

    def __init__(self, state: list | None):
        self.entity, self.top, self.start = state or (None, 0, 0)
        self.first = None

    def feed(self, batch: pa.RecordBatch) -> dict | None:
        """One row for each island touched by the batch, by position: key, island start, largest end, end before it."""
        n = batch.num_rows
        if not n:
            return None
        keys = batch.column(0)
        codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        start = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        end = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = codes[1:] != codes[:-1]
        head = keys[0].as_py()
        if self.first is None:
            self.first = head
        joined = head == self.entity
        fresh[0] = not joined
        seg = np.cumsum(fresh)
        # a cumulative maximum that restarts at each entity: lift every entity above the one before it
        raised = end.copy()
        if joined:
            raised[0] = max(raised[0], self.top)
        low = int(raised.min())
        span = int(raised.max()) - low + 1
        if span * (int(seg[-1]) + 1) < 2**62:
            lift = seg * span
            top = np.maximum.accumulate(raised - low + lift) - lift + low
        else:
            top = raised.copy()
            for a, b in zip(np.flatnonzero(np.r_[True, fresh[1:]]), np.r_[np.flatnonzero(np.r_[False, fresh[1:]]), n]):
                top[a:b] = np.maximum.accumulate(raised[a:b])
        before = np.empty(n, np.int64)
        before[1:] = top[:-1]
        before[0] = self.top
        new = fresh | (start > before)
        at = np.flatnonzero(new)
        has_prev = ~fresh[at]
        cuts = at if at.size and at[0] == 0 else np.r_[0, at]
        carried = cuts.size != at.size
        island = start[cuts].copy()
        prev_end = np.where(has_prev, before[at], 0)
        if carried:  # the first rows go on with the island that was open
            island[0] = self.start
            has_prev, prev_end = np.r_[False, has_prev], np.r_[0, prev_end]
        last = np.r_[cuts[1:], n] - 1
        self.entity, self.top, self.start = keys[n - 1].as_py(), int(top[-1]), int(island[-1])
        return {"key": keys.take(pa.array(cuts)), "start": island, "end": top[last], "prev": prev_end, "has_prev": has_prev}


def _summarise(batches: Batches) -> list | None:
    s = _Islands(None)
    for b in batches:
        s.feed(b)
    return None if s.first is None else [s.first, s.entity, s.top, s.start]


def _combine(state: list | None, summary: list) -> list:
    first, last, top, start = summary
    if state is None or state[0] != last or first != last:
        return [last, top, start]
    # one entity fills the partition: its last island stands only if it starts after all earlier ends
    return [last, max(top, state[1]), start if start > state[1] else state[2]]


def _rescan(batches: Batches, state: list | None) -> Iterator[pa.RecordBatch]:
    s = _Islands(state)
    for b in batches:
        if (got := s.feed(b)) is not None:
            yield pa.RecordBatch.from_arrays(
                [got["key"], pa.array(got["start"]), pa.array(got["end"]), pa.array(got["prev"], mask=~got["has_prev"])],
                names=["key", "start_ms", "end_ms", "prev_end"],
            )


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, max_gap: int | None = None) -> DataFrame:
    """Continuous periods of each entity and the gaps between neighbouring periods.

    keys are STRING columns, start and end BIGINT. Rows with a null key or bound, or with end not above start, are
    left out; touching intervals are one period; repeated rows change nothing; a gap over max_gap is not listed
    (None lists all). Result: keys, kind ('period' or 'gap'), start_ms, end_ms; no rows for an empty input. Other
    columns of df, whatever their names, are not read.

    Global range sort by (entity, start), summaries of largest ends by partition, prefix combination, rescan with the
    carried end and island start; islands cut by a partition or batch are joined by one partial-final aggregate.
    """
    ok = F.col(end) > F.col(start)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    rows = df.where(ok).select(
        packed_key([F.col(k) for k in keys]).alias("key"), F.col(start).alias("start_ms"), F.col(end).alias("end_ms")
    )
    pieces = carry_scan(
        range_sorted(rows, ["key", "start_ms"]), _summarise, _combine, _rescan, "key string, start_ms bigint, end_ms bigint, prev_end bigint"
    )
    islands = pieces.groupBy("key", "start_ms").agg(F.max("end_ms").alias("end_ms"), F.max("prev_end").alias("prev_end"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_ms"), F.col("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("prev_end").alias("start_ms"), F.col("start_ms").alias("end_ms")),
    )
    listed = (F.col("x.kind") == "period") | F.col("x.start_ms").isNotNull()
    if max_gap is not None:
        listed = (F.col("x.kind") == "period") | (F.col("x.end_ms") - F.col("x.start_ms") <= max_gap)
    parts = unpacked_key(F.col("key"), len(keys))
    return (
        islands.select("key", F.explode(both).alias("x"))
        .where(listed)
        .select(*[parts[i].alias(k) for i, k in enumerate(keys)], F.col("x.kind").alias("kind"), F.col("x.start_ms").alias("start_ms"), F.col("x.end_ms").alias("end_ms"))
    )


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, closed: bool, null_is_true: bool) -> Column:
    """Overlap of two intervals; both switches must be chosen, as unlike rules exist side by side."""
    a, b = F.least(e1, e2), F.greatest(s1, s2)
    hit = (a >= b) if closed else (a > b)
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, hit).otherwise(F.lit(null_is_true))


#: an interval is cut into at most about so many buckets; longer ones use buckets this much wider, level by level
FAN = 64


def overlap_join(
    left: DataFrame, right: DataFrame, on: list[str], width: int, lstart: str = "l_start", lend: str = "l_end", rstart: str = "r_start", rend: str = "r_end"
) -> DataFrame:
    """Inner join of rows of the same entity whose intervals strictly overlap.

    Both sides are exploded into time buckets of `width`, joined on (entity, bucket), and a pair is kept only in the
    bucket that holds the later start, so it comes once. Rows with null bounds or end not above start match nothing.

    Where an interval is longer than FAN buckets (found by one aggregate over each side's bounds), buckets have levels,
    each FAN times wider than the one below: every interval lies on its own level in at most FAN + 1 buckets, and in one or
    two on each level above, where it meets the longer intervals only. So a row with a wild end makes no more copies than
    others, and rows without one never meet in wide buckets.
    """
    bounds = ((left, lstart, lend), (right, rstart, rend))
    longest = max(df.agg(F.max(F.col(e).cast("double") - F.col(s).cast("double"))).first()[0] or 0.0 for df, s, e in bounds)
    levels = 0
    while longest > width * FAN ** (levels + 1):
        levels += 1

    def wide(level: Column | int) -> Column:
        return F.element_at(F.array(*[F.lit(width * FAN**k) for k in range(levels + 1)]), level + 1) if levels else F.lit(width)

    def buckets(df: DataFrame, s: str, e: str, lifted: bool) -> DataFrame:
        real = df.where(F.col(e) > F.col(s))
        if not levels:
            real = real.withColumn("_level", F.lit(0))
        else:
            length = F.col(e).cast("double") - F.col(s).cast("double")
            own = sum((F.when(length > width * FAN ** (k + 1), 1).otherwise(0) for k in range(levels)), F.lit(0))
            above = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda k: k > own)
            real = real.withColumn("_level", F.explode(above)) if lifted else real.withColumn("_level", own)
        place = lambda c: F.floor(F.col(c) / wide(F.col("_level"))).cast("bigint")
        return real.withColumn("_bucket", F.explode(F.sequence(place(s), place(e))))

    later = F.greatest(F.col(lstart), F.col(rstart))
    keys = [*on, "_level", "_bucket"] if levels else [*on, "_bucket"]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b if levels else b.drop("_level"), keys)
        once = F.col("_bucket") == F.floor(later / wide(F.col("_level"))).cast("bigint")
        return pairs.where((F.least(F.col(lend), F.col(rend)) > later) & once).drop("_bucket", "_level")

    own_left, own_right = buckets(left, lstart, lend, False), buckets(right, rstart, rend, False)
    if not levels:
        return met(own_left, own_right)
    all_right = own_right.unionByName(buckets(right, rstart, rend, True))
    return met(own_left, all_right).unionByName(met(buckets(left, lstart, lend, True), own_right))
