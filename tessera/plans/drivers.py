"""Plans of runs as tables: matrices of runs, their outcomes, staged columns with errors, payloads and path rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Three locked profiles of parameters
PROFILES = (("baseline", 1.0, 32, "none", "none"), ("dense", 2.0, 60, "none", "audio"), ("cropped", 2.0, 60, "role", "audio"))


def profiles(spark: SparkSession, rows: Sequence[tuple] = PROFILES) -> DataFrame:
    """The dimension table of profiles: profile, fps, frames, crop, audio."""
    return spark.createDataFrame(list(rows), "profile string, fps double, frames int, crop string, audio string")


def run_matrix(spark: SparkSession, dimensions: Mapping[str, Sequence[str]], template: str) -> DataFrame:
    """One row for each combination of the dimensions' values with its command: the template with {name} replaced. The
    dimensions are literals, so nothing is joined; their order is that of the result's run numbers (from 1)."""
    names = list(dimensions)
    df = spark.range(1).select(F.lit(0).alias("_"))
    for n in names:
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in dimensions[n]])).alias(f"_{n}", n))
    command: Column = F.lit(template)
    for n in names:
        command = F.replace(command, F.lit(f"{{{n}}}"), F.col(n))
    number = F.lit(1)
    for k, n in enumerate(names):
        block = 1
        for later in names[k + 1 :]:
            block *= len(dimensions[later])
        number = number + F.col(f"_{n}") * block
    return df.select(number.cast("int").alias("run"), *names, command.alias("command"))


def run_outcomes(exits: DataFrame, log: DataFrame, run: str, line_no: str, record: str) -> DataFrame:
    """exits (run, exit_code) with the last record of each run's log and its number of lines; a run without a log has
    NULL and 0. The last record is a map-side combined maximum, whatever the length of a log."""
    last = log.groupBy(run).agg(F.max_by(record, line_no).alias("last_record"), F.count(F.lit(1)).alias("lines"))
    return exits.join(last, run, "left").withColumn("lines", F.coalesce("lines", F.lit(0))).withColumn("failed", F.col("exit_code") != 0)


def staged(df: DataFrame, stages: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """df with, for each stage (name, value, error) in order, <name>_value, <name>_status and <name>_error.

    A stage whose error is not NULL fails: its value is NULL and all stages behind it are 'skipped'; no row stops
    another. `failed_stage` names the first that failed, NULL if none did."""
    alive, failed = F.lit(True), F.lit(None).cast("string")
    out = df
    for name, value, error in stages:
        out = out.withColumn(f"{name}_error", F.when(alive, error))
        ok = F.col(f"{name}_error").isNull()
        out = out.withColumn(f"{name}_status", F.when(~alive, "skipped").when(ok, "ok").otherwise("failed"))
        out = out.withColumn(f"{name}_value", F.when(F.col(f"{name}_status") == "ok", value))
        failed = F.coalesce(failed, F.when(F.col(f"{name}_status") == "failed", F.lit(name)))
        alive = F.col(f"{name}_status") == "ok"
    return out.withColumn("failed_stage", failed)


def remaining(df: DataFrame, log: DataFrame, key: str, state: str = "status") -> DataFrame:
    """Rows still to be run: those whose last entry in the log is not 'ok' (log: key, position, state)."""
    last = log.groupBy(key).agg(F.max_by(state, "position").alias("_last"))
    return df.join(last.where(F.col("_last") == "ok").select(key), key, "left_anti")


def first_available(*sources: Column) -> Column:
    """The first array that is neither NULL nor empty, else an empty one: fallback of sources in order."""
    return F.coalesce(*[F.when(F.size(s) > 0, s) for s in sources], F.slice(sources[0], 1, 0), F.array())


def path_under(path: Column, root: str) -> Column:
    """STRUCT(path, error): a relative path, or an absolute one under root, made absolute; URLs, empty paths and those
    that leave the root are errors and have no path."""
    bare = F.trim(path)
    whole = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), bare))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    # a step up takes the step before it away; more steps up than down leave the root of the file system
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    clean = F.concat(F.lit("/"), F.array_join(walked, "/"))
    error = F.when(F.coalesce(bare, F.lit("")) == "", "empty").when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "url").when(~F.concat(clean, F.lit("/")).startswith(root.rstrip("/") + "/"), "outside")
    return F.struct(F.when(error.isNull(), clean).alias("path"), error.alias("error"))


def review_payload(fields: Mapping[str, Column], sources: Mapping[str, Column]) -> Column:
    """JSON of the fields, then of what each source says, in the given order; a source that says nothing is '[]'."""
    said = [F.struct(F.lit(n).alias("source"), F.coalesce(c, F.lit("[]")).alias("prediction")) for n, c in sources.items()]
    return F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()], F.array(*said).alias("predictions")))
