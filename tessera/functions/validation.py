"""Row validation: cells with reasons, violation lists, masking, and tri-state flags."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def violations(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that do not hold, in order; a NULL check does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))


def json_or_error(text: Column, field: str, row: Column) -> Column:
    """STRUCT(value VARIANT, error): error names the field and the row where the cell is filled and does not parse."""
    value = F.try_parse_json(text)
    bad = value.isNull() & (F.trim(text) != "")
    return F.struct(value.alias("value"), F.when(bad, F.concat(F.lit(f"{field}: no JSON in row "), row.cast("string"))).alias("error"))


def clean_strings(values: Column, distinct: bool = False) -> Column:
    """Trimmed, without nulls and blanks, optionally each once in order."""
    out = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(out) if distinct else out


def _filled(value: object) -> bool:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            if v.strip():
                return True
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v
        elif v is not None:
            return True
    return False


def has_content(text: Column) -> Column:
    """Whether a JSON text holds any value that is not empty at any depth; a text that is no JSON counts as itself."""

    def run(cells: pd.Series) -> pd.Series:
        out = []
        for t in cells:
            try:
                out.append(t is not None and _filled(json.loads(t)))
            except (ValueError, RecursionError):
                out.append(bool(t.strip()))
        return pd.Series(out, dtype="bool")

    return F.pandas_udf(run, "boolean")(text)


def any_alias_filled(df: DataFrame, aliases: Sequence[str]) -> Column:
    """Whether any of the columns that the table has under these names is filled; resolved when the plan is built."""
    names = [c for c in df.columns if c.lower() in {a.lower() for a in aliases}]
    out = F.lit(False)
    for c in names:
        out = out | F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return out


def only_junk(values: Sequence[Column], exact: Sequence[str], pattern: str) -> Column:
    """At least one value is filled, and every filled one is in `exact` or matches the whole pattern."""
    filled = F.filter(F.transform(F.array(*values), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))
    return (F.size(filled) > 0) & F.forall(filled, lambda v: v.isin(list(exact)) | v.rlike(f"^(?:{pattern})$"))


def run_state(success: Column, status: Column, error: Column) -> Column:
    """'failed', 'ok' or 'unknown': never a negative out of a null."""
    failed = (success == F.lit(False)) | F.lower(status).isin("failed", "error") | (F.trim(error) != "")
    fine = (success == F.lit(True)) | F.lower(status).isin("ok", "success")
    return F.when(F.coalesce(failed, F.lit(False)), "failed").when(F.coalesce(fine, F.lit(False)), "ok").otherwise("unknown")


def mask_nested(items: Column, field: str, keep: Column) -> Column:
    """The array with `field` of every struct set to NULL unless `keep`."""
    return F.when(F.coalesce(keep, F.lit(False)), items).otherwise(F.transform(items, lambda x: x.withField(field, F.lit(None).cast("string"))))


def provided(material: dict[str, Column]) -> Column:
    """A sample masked to what was provided: name -> whether it is filled."""
    return F.struct(*[F.coalesce(F.trim(c.cast("string")) != "", F.lit(False)).alias(n) for n, c in material.items()])


def missing_needs(needs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of what is asked for and not provided: name -> (needed, provided)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(need, F.lit(False)) & ~F.coalesce(have, F.lit(False)), F.lit(n)) for n, (need, have) in needs.items()]))


def required_clause(text: Column, pattern: str, negations: Sequence[str], within: int = 20) -> Column:
    """Whether the pattern stands in the text without a negation in the `within` characters before it."""
    no = "|".join(negations)
    return text.rlike(pattern) & ~text.rlike(f"(?:{no}).{{0,{within}}}?(?:{pattern})")


def around(text: Column, mention: Column, before: int = 24, after: int = 120) -> Column:
    """The text from `before` characters ahead of a mention to `after` behind it; NULL where it is not mentioned."""
    at = F.instr(text, mention)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(mention) + after))
