"""Runs of neighbouring rows: sessions, adjacent merges, relabelling, and greedy operators on independent runs.

Runs are labelled by a carried scan over globally sorted rows, so a long entity is not held by one task. A run's
boundary depends on two neighbours only; what happens inside a run may then be aggregated, or, where it is greedy,
be handed to one Arrow function for each run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.carryscan import Batches, carry_scan, range_sorted

Rows = dict[str, np.ndarray]


def label_runs(df: DataFrame, entity: str, order: list[str], columns: list[str], boundary: Callable[[Rows, Rows], np.ndarray]) -> DataFrame:
    """df with run_start, the last order column's value at the first row of the row's run.

    Rows are sorted by (entity, *order); order must be unique in an entity and its last column BIGINT. boundary gets
    `columns` of neighbouring rows of one entity (before, row) as arrays and says where a run begins; an entity's first
    row begins one. Rows with a null entity are left out; nulls of other columns reach boundary as None or NaN.
    """
    at = order[-1]
    rest = [c for c in df.columns if c not in (entity, *order)]
    rows = df.where(F.col(entity).isNotNull()).select(entity, *order, *rest)
    names = rows.columns
    key, pos, used = names.index(entity), names.index(at), [names.index(c) for c in columns]

    def values(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return np.array(batch.column(i).to_pylist(), dtype=object) if not pa.types.is_floating(batch.schema.field(i).type) else batch.column(i).to_numpy(zero_copy_only=False)

    class Scan:
        def __init__(self, state: list | None):
            self.entity, self.last, self.start = state or (None, None, None)

        def feed(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            """(run start, begins-by-boundary) by row; the second is False on an entity's first row."""
            ents = values(batch, key)
            at_ = np.array(batch.column(pos).to_pylist(), dtype=np.int64)
            n = len(ents)
            cols = [values(batch, i) for i in used]
            fresh = np.ones(n, bool)
            fresh[1:] = ents[1:] != ents[:-1]
            fresh[0] = ents[0] != self.entity
            prev = []
            for c, last in zip(cols, self.last or [None] * len(cols)):
                p = np.empty(n, dtype=c.dtype)
                p[1:] = c[:-1]
                p[0] = c[0] if fresh[0] else last
                prev.append(p)
            new = np.asarray(boundary(dict(zip(columns, prev)), dict(zip(columns, cols))), bool) & ~fresh
            begins = new | fresh
            where = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            start = np.where(where >= 0, at_[np.maximum(where, 0)], self.start if self.start is not None else 0)
            plain = lambda x: x.item() if isinstance(x, np.generic) else x
            self.entity, self.last, self.start = ents[-1], [plain(c[-1]) for c in cols], int(start[-1])
            return start, new

    def summarise(batches: Batches) -> dict | None:
        scan, first, single, inner = Scan(None), None, True, None
        for b in batches:
            if b.num_rows:
                head = b.column(key)[0].as_py()
                if first is None:
                    plain = lambda x: x.item() if isinstance(x, np.generic) else x
                    first = [head, [plain(values(b, i)[0]) for i in used], b.column(pos)[0].as_py()]
                start, new = scan.feed(b)
                single = single and b.column(key)[b.num_rows - 1].as_py() == first[0] and head == first[0]
                if single and new.any():
                    inner = int(start[-1])
        return None if first is None else {"first": first, "single": single, "inner": inner, "tail": [scan.entity, scan.last, scan.start]}

    def combine(state: list | None, s: dict) -> list:
        ent, vals, at_first = s["first"]
        if state is None or not s["single"] or state[0] != ent:
            return s["tail"]
        one = lambda xs: {c: np.array([x], dtype=object if not isinstance(x, float) else float) for c, x in zip(columns, xs)}
        start = s["inner"] if s["inner"] is not None else at_first if bool(boundary(one(state[1]), one(vals))[0]) else state[2]
        return [ent, s["tail"][1], start]

    def rescan(batches: Batches, state: list | None) -> Iterator[pa.RecordBatch]:
        scan = Scan(state)
        for b in batches:
            if b.num_rows:
                start, _ = scan.feed(b)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64())], names=[*names, "run_start"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("run_start", LongType())])
    return carry_scan(range_sorted(rows, [entity, *order]), summarise, combine, rescan, schema)


def numbered(df: DataFrame, entity: str, order: list[str], weight: str | None = None) -> DataFrame:
    """df with a sequence number from 1 inside its entity, by a carried count over globally sorted rows: the number of
    rows up to and with this one, or the sum of their weight (BIGINT). Rows with a null entity are left out."""
    from pyspark.sql.types import LongType, StructField, StructType

    rows = df.where(F.col(entity).isNotNull())
    names = rows.columns
    key, heavy = names.index(entity), None if weight is None else names.index(weight)

    def counted(batch: pa.RecordBatch, ent: object, n: int) -> tuple[np.ndarray, object, int]:
        codes = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        each = np.ones(batch.num_rows, np.int64) if heavy is None else batch.column(heavy).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(each)
        no = upto - np.repeat((upto - each)[starts], np.diff(np.r_[starts, batch.num_rows]))
        if batch.column(key)[0].as_py() == ent:
            no[: starts[1] if len(starts) > 1 else batch.num_rows] += n
        return no, batch.column(key)[batch.num_rows - 1].as_py(), int(no[-1])

    def summarise(batches: Batches) -> list | None:
        first = ent = None
        n = 0
        for b in batches:
            if b.num_rows:
                first = b.column(key)[0].as_py() if first is None else first
                _, ent, n = counted(b, ent, n)
        return None if first is None else [first, ent, n]

    def combine(state: list | None, s: list) -> list:
        first, ent, n = s
        return [ent, n + (state[1] if state is not None and first == ent == state[0] else 0)]

    def rescan(batches: Batches, state: list | None) -> Iterator[pa.RecordBatch]:
        ent, n = state or (None, 0)
        for b in batches:
            if b.num_rows:
                no, ent, n = counted(b, ent, n)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(no, pa.int64())], names=[*names, "sequence"])

    schema = StructType([*rows.schema.fields, StructField("sequence", LongType())])
    return carry_scan(range_sorted(rows, [entity, *order]), summarise, combine, rescan, schema)


def sessions(df: DataFrame, entity: str, time_ms: str, row_id: str, gap_ms: int) -> DataFrame:
    """df with run_start: a new session where the time since the row before exceeds gap_ms."""
    return label_runs(df, entity, [time_ms, row_id], [time_ms], lambda a, b: (b[time_ms] - a[time_ms]).astype(np.int64) > gap_ms)


def spoken_groups(tokens: DataFrame, entity: str, pos: str, gap: float = 0.24) -> DataFrame:
    """Token groups: a new one on another speaker, behind terminal punctuation, and after a silence over `gap` seconds
    unless the token is terminal punctuation itself. Needs speaker, start_sec, end_sec, terminal BOOLEAN."""

    def boundary(a: Rows, b: Rows) -> np.ndarray:
        silence = np.asarray(b["start_sec"], float) - np.asarray(a["end_sec"], float) > gap
        own = np.asarray(b["terminal"], bool)
        return np.asarray(a["terminal"], bool) | np.array([x != y for x, y in zip(a["speaker"], b["speaker"])], bool) | (silence & ~own)

    return label_runs(tokens, entity, [pos], ["speaker", "start_sec", "end_sec", "terminal"], boundary)


def first_seen_relabel(df: DataFrame, entity: str, label: str, pos: str) -> DataFrame:
    """df with label_no: labels numbered from 0 in the order they are first seen in their entity."""
    firsts = df.groupBy(entity, label).agg(F.min(pos).alias("_first"))
    seen = firsts.groupBy(entity).agg(F.array_sort(F.collect_list("_first")).alias("_seen"))  # one value a label
    numbered = firsts.join(seen, entity).select(F.col(entity).alias("_e"), F.col(label).alias("_l"), (F.array_position("_seen", F.col("_first")) - 1).cast("int").alias("label_no"))
    return df.join(numbered, F.col(entity).eqNullSafe(F.col("_e")) & F.col(label).eqNullSafe(F.col("_l")), "left").drop("_e", "_l")


def merge_adjacent(df: DataFrame, entity: str, key: str, row_id: str, start: str, end: str, gap: int) -> DataFrame:
    """Neighbouring intervals of one key at most `gap` apart (against the largest end so far) as one: entity, key,
    start, end. Key runs first, so intervals of a key with others between them stay apart."""
    from tessera.functions.keys import packed_key, unpacked_key
    from tessera.operators.intervals import periods_and_gaps

    runs = label_runs(df.select(entity, start, row_id, key, end), entity, [start, row_id], [key], lambda a, b: np.array([x != y for x, y in zip(a[key], b[key])], bool))
    reach = runs.select(packed_key([F.col(entity), F.col(key), F.col("run_start").cast("string")]).alias("_run"), start, (F.col(end) + gap).alias("_end"))
    merged = periods_and_gaps(reach, ["_run"], start, "_end").where(F.col("kind") == "period")
    part = unpacked_key(F.col("_run"), 3)
    return merged.select(part[0].alias(entity), part[1].alias(key), F.col("start_ms").alias(start), (F.col("end_ms") - gap).alias(end))


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """fn over the rows (dicts, in order) of each group, as rows of schema: hash-partitioned by keys, sorted, and cut
    into groups in one pass over Arrow batches, so small groups cost no call of their own."""
    names = [f.strip().split()[0] for f in _fields(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[dict] = []
        last, out = None, []
        for pdf in frames:
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != last and group:
                    out += fn(group)
                    group = []
                last = key
                group.append(row)
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if group:
            out += fn(group)
        yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Column definitions of a DDL string, nested types kept whole."""
    out, depth, cur = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def by_run(df: DataFrame, entity: str, order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """by_group over the runs of label_runs: a greedy operator never holds more than one run."""
    return by_group(df, [entity, "run_start"], order, fn, schema)


def windows(df: DataFrame, entity: str, pos: str, width: int, columns: list[str]) -> DataFrame:
    """Rows and their next width-1 neighbours in `pos` (consecutive integers) as an array, by equi-joins on position."""
    out = df.select(entity, F.col(pos).alias("pos"), F.array(F.struct(*columns)).alias("window"))
    for k in range(1, width):
        nxt = df.select(entity, (F.col(pos) - k).alias("pos"), F.struct(*columns).alias("_n"))
        out = out.join(nxt, [entity, "pos"]).select(entity, "pos", F.array_append("window", F.col("_n")).alias("window"))
    return out


def compatible_neighbours(left: Column, right: Column, gap: float = 1.25) -> Column:
    """Two segments may share a context: close together and not of two known different speakers."""
    other = left["speaker"].isNotNull() & right["speaker"].isNotNull() & (left["speaker"] != right["speaker"])
    return (right["start_sec"] - left["end_sec"] <= gap) & ~other
