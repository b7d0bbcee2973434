"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def counts_with_zeros(df: DataFrame, key: str, domain: list) -> DataFrame:
    """Rows by key over a fixed domain; values outside it are left out, missing ones count 0."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    dim = spark.createDataFrame([(v,) for v in domain], f"{key} {kind}")
    return dim.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, row: str, column: str, domain: list) -> DataFrame:
    """Counts of each domain value as columns c_<value> by row, in one aggregation."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"c_{v}") for v in domain])


def precision_recall(df: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision and recall; a rate with denominator 0 is NULL; null flags count on neither side."""
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)
    out = df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def support(df: DataFrame, keys: list[str], duration: str, turn: str, weight: str | None = None) -> DataFrame:
    """Duration, weighted duration, distinct turns and segments by keys."""
    w = F.col(weight) if weight else F.lit(1.0)
    return df.groupBy(*keys).agg(
        F.sum(F.col(duration) * w).alias("weighted"), F.sum(duration).alias("duration"), F.countDistinct(turn).alias("turns"), F.count(F.lit(1)).alias("segments")
    )


def top_with_margin(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Best item of each group (ties: smaller item), its share of the group's score and its margin over the next.

    Scores are summed by (group, item) first, map-side, so an item comes once; best and next are then two maxima."""
    items = df.groupBy(group, item).agg(F.sum(score).alias("s"))
    best = items.groupBy(group).agg(F.sum("s").alias("total"), F.min(F.struct((-F.col("s")).alias("n"), F.col(item).alias("i"))).alias("b"))
    rest = items.join(best.select(F.col(group), F.col("b.i").alias("_i")), group).where(~F.col(item).eqNullSafe(F.col("_i"))).groupBy(group).agg(F.max("s").alias("next"))
    return best.join(rest, group, "left").select(
        group, F.col("b.i").alias(item), (-F.col("b.n")).alias("score"), F.try_divide(-F.col("b.n"), F.col("total")).alias("share"), (-F.col("b.n") - F.coalesce("next", F.lit(0))).alias("margin")
    )


def shared_keys(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a that meet more than one b: a, the sorted b's."""
    return df.groupBy(a).agg(F.array_sort(F.collect_set(b)).alias("others")).where(F.size("others") > 1)


def sum_map(df: DataFrame, usage: Column) -> DataFrame:
    """Sum by key of a MAP<STRING, DOUBLE> column."""
    return df.select(F.explode(usage).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def word_confidence(words: Column, high: float = 0.8) -> Column:
    """'high' or 'medium' by the mean of the known word probabilities; NULL where none is known."""
    known = F.filter(F.transform(words, lambda w: w["probability"]), lambda p: p.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.size(known)
    return F.when(F.size(known) > 0, F.when(mean >= high, "high").otherwise("medium"))


def exact_median(df: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """Exact median by group (group, median), each row counted `weight` times (once without): equal values are counted
    first, map-side, then ranks come from a carried scan over the global order of what is left, so no task holds a
    group's values. Nulls of either column are left out."""
    from tessera.operators.runs import numbered

    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(n.cast("bigint").alias("_n"))
    ranked = numbered(rows, group, [value], "_n")
    total = ranked.groupBy(group).agg(F.max("sequence").alias("_all"))
    # the one or two middle ranks, and how many of them fall on a value
    on = sum(((k > F.col("sequence") - F.col("_n")) & (k <= F.col("sequence"))).cast("int") for k in (F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1))
    return ranked.join(total, group).withColumn("_on", on).where("_on > 0").groupBy(group).agg((F.sum(F.col(value) * F.col("_on")) / 2).alias("median"))


def robust_events(df: DataFrame, group: str, value: str, factor: float = 4.0, least: float = 0.11, floor: float = 0.005) -> DataFrame:
    """Median, median absolute deviation, the adaptive threshold and the values above it, by group; all from the counts
    of the distinct values."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    med = exact_median(counts, group, value, "n").withColumnRenamed("median", "med")
    away = counts.join(med, group).select(group, F.abs(F.col(value) - F.col("med")).alias("away"), "n")
    line = med.join(exact_median(away, group, "away", "n").withColumnRenamed("median", "mad"), group)
    line = line.withColumn("threshold", F.greatest(F.lit(least), F.col("med") + factor * F.greatest(F.col("mad"), F.lit(floor))))
    above = counts.join(line, group).groupBy(group).agg(F.sum(F.when(F.col(value) > F.col("threshold"), F.col("n")).otherwise(0)).alias("events"))
    return line.join(above, group).select(group, "med", "mad", "threshold", "events")


def strongest(level: Column, order: list[str]) -> Column:
    """Aggregate: the level that stands last in `order`."""
    return F.max_by(level, F.array_position(F.array(*[F.lit(x) for x in order]), level))


def group_status(status: Column) -> Column:
    """Aggregate: 'ok' if any is, else 'failed' if any is, else 'not_applicable'."""
    return F.when(F.bool_or(status == "ok"), "ok").when(F.bool_or(status == "failed"), "failed").otherwise("not_applicable")


def tool_stats(trace: DataFrame, tool: str, cache: str, status: str) -> DataFrame:
    """Requests, cache hits and misses, and returns by status of each tool."""
    return trace.groupBy(tool).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(cache) == "hit").alias("hits"), F.count_if(F.col(cache) == "miss").alias("misses"),
        *[F.count_if(F.col(status) == s).alias(s) for s in ("ok", "failed", "not_applicable")],
    )
