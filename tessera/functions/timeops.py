"""Seconds as doubles, compared as whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_ms(sec: Column) -> Column:
    """round(seconds * 1000) as BIGINT; NULL for null, NaN, infinite and absurdly large values."""
    ms = F.round(sec * 1000)
    return F.when(F.abs(ms) < F.lit(9.0e15), ms.cast("bigint"))
