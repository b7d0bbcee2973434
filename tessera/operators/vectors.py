"""Pairs of vectors by cosine, over whole tables and inside blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: vectors of one tile; two of them are held at a time
TILE = 2048
#: more than the rounding of a matrix product of unit vectors
_SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Sum of products in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def block_pairs(df: DataFrame, block: str, key: str, vector: str, least: float) -> DataFrame:
    """left_id < right_id and cosine of pairs of one block (a clip's voices, a label) that reach `least`.

    Blocks must be small by nature; `all_pairs` compares a whole table."""
    a = df.select(F.col(block).alias("block"), F.col(key).alias("left_id"), F.col(vector).alias("_a"))
    b = df.select(F.col(block).alias("block"), F.col(key).alias("right_id"), F.col(vector).alias("_b"))
    pairs = a.join(b, "block").where(F.col("left_id") < F.col("right_id")).withColumn("cosine", cosine(F.col("_a"), F.col("_b")))
    return pairs.where(F.col("cosine") >= least).select("block", "left_id", "right_id", "cosine")


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosines, added up in the order of `cosine`."""
    sums = np.zeros((3, len(a)))
    for d in range(a.shape[1]):
        sums += a[:, d] * b[:, d], a[:, d] * a[:, d], b[:, d] * b[:, d]
    return sums[0] / (np.sqrt(sums[1]) * np.sqrt(sums[2]))


def _tiled(df: DataFrame, key: str, vector: str, fn: Callable, schema: str, tile: int, block: str | None = None) -> DataFrame:
    """fn(left ids, left vectors, right ids, right vectors, cosines, type of the ids) on each two tiles of the table, or of
    each block (with the block before the columns of schema), every pair of rows with left id < right id in one of them;
    of other places the cosine is NaN. Vectors that are null, have null or NaN elements or no length have no cosine;
    vectors of different widths have none with each other."""
    kept = df.select((F.col(block) if block else F.lit(0)).alias("block"), F.col(key).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("width")).where(F.col("id").isNotNull() & (F.col("width") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    count = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / tile)).alias("tiles")
    if block:
        tiles = kept.groupBy(F.col("block").alias("_block")).agg(count)
        counted = kept.join(tiles, kept["block"].eqNullSafe(tiles["_block"])).drop("_block")
        schema = f"block {kept.schema['block'].dataType.simpleString()}, {schema}"
    else:
        counted = kept.crossJoin(F.broadcast(kept.groupBy().agg(count)))
    own = counted.withColumn("own", F.pmod(F.xxhash64("id"), "tiles"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    met = met.select("block", "id", "v", "width", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        width, low, high = (x.as_py() for x in group[1:])
        ids, at = rows["id"].to_numpy(), rows["own"].to_numpy()
        v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        some = (v * v).sum(axis=1) > 0
        ids, at, v = ids[some], at[some], v[some]
        u = v / np.sqrt((v * v).sum(axis=1))[:, None]
        a, b = at == low, at == high
        cosines = u[a] @ u[b].T
        if low == high:
            cosines[~(ids[:, None] < ids[None, :])] = np.nan
        out = fn(ids[a], v[a], ids[b], v[b], cosines, rows.schema.field("id").type)
        return out.add_column(0, "block", pa.array([group[0].as_py()] * out.num_rows, group[0].type)) if block else out

    return met.groupBy("block", "width", "low", "high").applyInArrow(run, schema)


def all_pairs(df: DataFrame, key: str, vector: str, least: float, tile: int = TILE) -> DataFrame:
    """left_id < right_id and cosine of every pair of the table that reaches `least`: tiles of the table against each
    other, so no pair is lost and no more than two tiles are held. The work grows with the square of the rows."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def like(left, a, right, b, cosines, ids) -> pa.Table:
        i, j = np.nonzero(cosines >= least - _SLACK)
        c = _exact(a[i], b[j])
        i, j, c = i[c >= least], j[c >= least], c[c >= least]
        swap = (left[i] > right[j]).astype(bool)
        first, second = np.where(swap, right[j], left[i]), np.where(swap, left[i], right[j])
        return pa.table({"left_id": pa.array(first, ids), "right_id": pa.array(second, ids), "cosine": c})

    return _tiled(df, key, vector, like, f"left_id {kind}, right_id {kind}, cosine double", tile)


def pair_decision(similarity: Column, same: float = 0.55, different: float = 0.30) -> Column:
    """'same', 'different' or 'ambiguous'; NULL stays 'not_evaluable'."""
    return F.when(similarity.isNull(), "not_evaluable").when(similarity >= same, "same").when(similarity <= different, "different").otherwise("ambiguous")


def block_extremes(df: DataFrame, block: str, key: str, vector: str, tile: int = TILE) -> DataFrame:
    """Least and greatest cosine of the pairs of each block, exact; blocks without a pair have no row."""

    def ends(left, a, right, b, cosines, ids) -> pa.Table:
        if not np.isfinite(cosines).any():
            return pa.table({"low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        i, j = np.nonzero((cosines <= np.nanmin(cosines) + _SLACK) | (cosines >= np.nanmax(cosines) - _SLACK))
        c = _exact(a[i], b[j])
        return pa.table({"low": [c.min()], "high": [c.max()]})

    found = _tiled(df, key, vector, ends, "low double, high double", tile, block)
    return found.groupBy("block").agg(F.min("low").alias("min_cosine"), F.max("high").alias("max_cosine"))


def block_quality(df: DataFrame, block: str, key: str, vector: str) -> DataFrame:
    """Members, pairs and mean, least and greatest pairwise cosine of each block: the mean from the norm of the sum of
    unit vectors, the ends from all pairs.

    Mean cosine over pairs = (|sum|^2 - n) / (n (n - 1))."""
    unit = df.select(F.col(block).alias("block"), F.col(key), F.posexplode(vector).alias("dim", "x"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("len"))
    sums = unit.groupBy("block", "dim").agg(F.sum(F.col("x").cast("double") / F.col("len")).alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    means = sums.groupBy("block").agg(n.alias("members"), (n * (n - 1) / 2).cast("bigint").alias("pairs"), F.try_divide(F.sum(F.col("s") * F.col("s")) - n, n * (n - 1)).alias("mean_cosine"))
    ends = block_extremes(df, block, key, vector).withColumnRenamed("block", "_b")
    return means.join(ends, means["block"].eqNullSafe(ends["_b"]), "left").drop("_b")
