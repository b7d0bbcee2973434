"""Segmented scans over globally sorted rows with carried state.

Rows are range-partitioned and sorted by (entity, order); every partition yields one summary row, the summaries are
combined from left to right on the driver (one row a partition, whatever the data), and a second pass rescans each
partition with the state it starts from. An entity may span any number of partitions, so no entity is ever held by
one task. The sorted rows are checkpointed in the shared folder: both passes see the same partitions, also after the
loss of an executor.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.runtime import cut, shards

Batches = Iterable[pa.RecordBatch]
_SUMMARY = "pid int, summary string"


def range_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Global order by keys, with equal keys in one partition."""
    return df.repartitionByRange(shards(df), *keys).sortWithinPartitions(*keys)


def carry_scan(
    ordered: DataFrame,
    summarise: Callable[[Batches], Any],
    combine: Callable[[Any, Any], Any],
    rescan: Callable[[Batches, Any], Iterator[pa.RecordBatch]],
    schema: str,
    stored: bool = False,
) -> DataFrame:
    """rescan(batches, state) over each partition of `ordered` (as of range_sorted), with state = combine(...) of the
    summaries of all partitions before it. summarise returns a JSON-serialisable summary, or None for no rows.
    combine(None, s) is the state after the first non-empty partition. `stored` says that `ordered` is checkpointed
    already."""
    rows = ordered if stored else cut(ordered)

    def first(batches: Batches) -> Iterator[pa.RecordBatch]:
        summary = summarise(batches)
        if summary is not None:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "summary": [json.dumps(summary)]})

    found = {r.pid: json.loads(r.summary) for r in rows.mapInArrow(first, _SUMMARY).collect()}
    starts: dict[int, Any] = {}
    state = None
    for pid in sorted(found):
        if state is not None:
            starts[pid] = state
        state = combine(state, found[pid])

    def second(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from rescan(batches, starts.get(TaskContext.get().partitionId()))

    return rows.mapInArrow(second, schema)
