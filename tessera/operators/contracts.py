"""Contracts of tables: keys, sets, order, and joins that must be complete. Violations are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """reason ('blank' or 'duplicate'), key and number of rows of every key that breaks the contract."""
    counts = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.coalesce(F.trim("key"), F.lit("")) == ""
    reason = F.when(blank, "blank").when(F.col("n") > 1, "duplicate")
    return counts.select(reason.alias("reason"), "key", "n").where(F.col("reason").isNotNull())


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side ('left' or 'right') and key of keys that the other table lacks; null keys are orphans of their side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").select(F.lit(side).alias("side"), F.col(key).alias("key"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with their multiplicity) that only one side has: side and the columns of left."""
    right = right.select(*left.columns)
    return left.exceptAll(right).select(F.lit("left").alias("side"), "*").unionByName(right.exceptAll(left).select(F.lit("right").alias("side"), "*"))


def aligned_join(left: DataFrame, right: DataFrame, position: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Join of rows equal in position and key, and the positions where the two tables disagree."""
    joined = left.join(right, [position, key])
    both = left.select(position, F.col(key).alias("left_key")).join(right.select(position, F.col(key).alias("right_key")), position, "full_outer")
    return joined, both.where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def complete_left_join(left: DataFrame, right: DataFrame, key: str, default: dict[str, object] | None = None) -> DataFrame:
    """LEFT join with `found`; missing right columns take the defaults given for them."""
    out = left.join(right.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    for c, v in (default or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one with the largest order, by a map-side combined maximum (no window over a hot key)."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one with the smallest order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def on_duplicate(df: DataFrame, key: str, order: str, policy: str) -> DataFrame:
    """policy 'first' or 'last' keeps one row a key; 'error' keeps all and adds `is_duplicate`."""
    if policy == "last":
        return last_wins(df, key, order)
    if policy == "first":
        return first_wins(df, [key], order)
    if policy != "error":
        raise ValueError(policy)
    return df.join(df.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("is_duplicate")), key)


def allow_list(df: DataFrame, columns: list[str], id_column: str, position: str) -> DataFrame:
    """Projection of the allowed columns only; a blank id becomes '#' and the position."""
    named = F.coalesce(F.when(F.trim(id_column) != "", F.col(id_column)), F.concat(F.lit("#"), F.col(position)))
    return df.select(named.alias(id_column), *[F.col(c) for c in columns if c != id_column])


def first_filled(*columns: Column) -> Column:
    """First text that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def select_rows(df: DataFrame, position: str, start: int = 1, limit: int | None = None, rows: list[int] | None = None) -> DataFrame:
    """`selected` by 1-based start and limit (None: all, 0: none), or by an explicit list; all rows stay."""
    if rows is not None:
        hit = F.col(position).isin(rows)
    else:
        hit = F.col(position) >= start
        if limit is not None:
            hit = hit & (F.col(position) < start + limit)
    return df.withColumn("selected", hit)


def batches(df: DataFrame, order: list[str], done: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Rows whose key is not done yet, with `batch` of about `size` rows each, for writers outside the engine."""
    n = max(1, -(-df.count() // size))
    return df.join(done.select(key).distinct(), key, "left_anti").withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)))
