"""Filling containers of fixed capacity with texts, measured in tokens."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.llm.tokens import RANKS, token_count

#: texts packed together by one task; the waste of the last containers of a group is spread over so many
GROUP_ITEMS = 4_096
_MAX_CAPACITIES = 1_000


def first_fit_decreasing(sizes: Iterable[int], capacity: int) -> list[int]:
    """Container (from 0) of each size, sizes given in falling order and none over the capacity.

    A tournament tree over the containers holds in every node the largest free space below it, so the first container
    with enough space is found in logarithmic time.
    """
    sizes = list(sizes)
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            top = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
    return out


_PLACED = "capacity_id int, capacity_tokens int, container_id string, doc_id bigint, piece_no int, start_token bigint, piece_tokens bigint"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["piece_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    group, capacity = pdf["_group"].iat[0], int(pdf["capacity_tokens"].iat[0])
    found = first_fit_decreasing(pdf["piece_tokens"].tolist(), capacity)
    return pdf.assign(container_id=[f"g{group}-{b}" for b in found])[[c.split()[0] for c in _PLACED.split(", ")]]


def pack_documents(docs: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str = RANKS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Where each text goes, for each capacity: capacity_id, capacity_tokens, container_id, doc_id, piece_no (from 1),
    start_token, piece_tokens.

    Only a text over the capacity is divided: into full containers of its own and one remainder, which is packed like
    a text. Null and empty texts have 0 tokens and still get a place. Repeated rows are items of their own; ties are
    placed by smaller key; an empty table gives no rows; capacities that are null or below 1 take nothing; other
    columns of docs are not read.

    Items are sent to random groups of about group_items by a hash of the key and packed there first-fit decreasing,
    so neither a source nor a size gathers in one task. The number of groups follows the number of rows.
    """
    found = capacities.where(F.col("capacity_tokens") >= 1).select("capacity_id", "capacity_tokens").distinct().limit(_MAX_CAPACITIES + 1).collect()
    if len(found) > _MAX_CAPACITIES:
        raise ValueError(f"more than {_MAX_CAPACITIES} capacities")
    groups = max(1, -(-docs.count() // group_items))
    kinds = F.array(*[F.struct(F.lit(r.capacity_id).alias("id"), F.lit(r.capacity_tokens).alias("size")) for r in sorted(found)]) if found else F.array().cast("array<struct<id:int,size:int>>")
    items = docs.select(F.col(key).alias("doc_id"), token_count(F.col(text), ranks_file).alias("n")).select("doc_id", "n", F.explode(kinds).alias("k"))
    items = items.select("doc_id", "n", F.col("k.id").alias("capacity_id"), F.col("k.size").alias("capacity_tokens"))
    full = F.floor(F.col("n") / F.col("capacity_tokens")).cast("int")
    own = F.when((F.col("n") > F.col("capacity_tokens")) & (full > 0), F.sequence(F.lit(1), full))
    rest = F.when(F.col("n") <= F.col("capacity_tokens"), F.array(F.lit(1))).when(F.col("n") % F.col("capacity_tokens") > 0, F.array(full + 1))
    pieces = items.withColumn("piece_no", F.explode(F.concat(F.coalesce(own, F.array().cast("array<int>")), F.coalesce(rest, F.array().cast("array<int>")))))
    pieces = pieces.withColumn("start_token", (F.col("piece_no").cast("bigint") - 1) * F.col("capacity_tokens"))
    pieces = pieces.withColumn("piece_tokens", F.least(F.col("n") - F.col("start_token"), F.col("capacity_tokens").cast("bigint")))
    # a full piece of a divided text fills its container: nothing else can be put there but texts of no tokens
    alone = (F.col("n") > F.col("capacity_tokens")) & (F.col("piece_tokens") == F.col("capacity_tokens"))
    placed = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string"))
    columns = [c.split()[0] for c in _PLACED.split(", ")]
    # one pass over the texts: full pieces ride along with the groups, spread like all others
    group = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(17)), F.lit(groups))
    tagged = pieces.withColumn("container_id", F.when(alone, placed)).withColumn("_group", group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf[pdf["container_id"].notna()]
        open_ = pdf[pdf["container_id"].isna()]
        parts = [done[columns]] + ([_pack(open_)] if len(open_) else [])
        return pd.concat(parts, ignore_index=True)

    return tagged.select("_group", *columns).groupBy("capacity_id", "_group").applyInPandas(run, _PLACED)


def fill_rates(placed: DataFrame) -> DataFrame:
    """Containers, tokens and unused share by capacity, with the least number of containers that could do."""
    boxes = placed.groupBy("capacity_id", "capacity_tokens", "container_id").agg(F.sum("piece_tokens").alias("used"))
    return boxes.groupBy("capacity_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_containers"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("unused_share"),
    )
