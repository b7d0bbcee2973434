"""Rule tables compiled into one expression each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def first_match(rules: Sequence[tuple[str, Column]], residual: str | None) -> Column:
    """Single label: that of the first rule that holds; NULL conditions do not hold."""
    out = None
    for label, condition in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(residual) if out is None else out.otherwise(F.lit(residual))


def all_matches(rules: Sequence[tuple[str, Column]]) -> Column:
    """Every label whose rule holds, in order of the rules, each once."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in rules])))


def reject_reason(gates: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first gate that does not hold (NULL counts as not holding), NULL if all do."""
    return first_match([(name, ~F.coalesce(ok, F.lit(False))) for name, ok in gates], None)


def partition_counts(df: DataFrame, label: Column, domain: list[str]) -> DataFrame:
    """Rows by label over the whole domain, empty labels with 0."""
    from tessera.operators.crosstabs import counts_with_zeros

    return counts_with_zeros(df.select(label.alias("label")), "label", domain)


def cascade(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with veto_stage, the first stage whose condition holds: an ordered chain of vetoes with an audit column."""
    return df.withColumn("veto_stage", first_match(stages, None))
