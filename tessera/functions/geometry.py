"""Time ranges, boxes and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_RANGE = r"^\s*(\d+(?:\.\d+)?)\s*(?:s|秒)?\s*[-–—~]\s*(\d+(?:\.\d+)?)\s*(?:s|秒)?\s*$"
_BBOX = r"([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)"


def time_range(text: Column, allow_empty: bool) -> Column:
    """STRUCT(start_sec, end_sec) of 'a s - b s'; NULL where it does not parse or end is below start (or equal to it,
    unless allow_empty)."""
    a, b = (F.regexp_extract(text, _RANGE, g).try_cast("double") for g in (1, 2))
    return F.when((b >= a) if allow_empty else (b > a), F.struct(a.alias("start_sec"), b.alias("end_sec")))


def format_range(start: Column, end: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}fs - %.{digits}fs", start, end)


def bbox_bounds(text: Column) -> Column:
    """STRUCT(x1, y1, x2, y2) of a box in unit coordinates; NULL unless ordered within 0..1."""
    p = [F.regexp_extract(text, _BBOX, g).try_cast("double") for g in range(1, 5)]
    return unit_box(*p)


def unit_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    ok = (x1 >= 0) & (y1 >= 0) & (x2 > x1) & (y2 > y1) & (x2 <= 1) & (y2 <= 1)
    return F.when(ok, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def scaled_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A box given in unit, per-mille or pixel scale, by its largest value, as a unit box."""
    top = F.greatest(x1, y1, x2, y2)
    fx = F.when(top > 1000, width).when(top > 1, F.lit(1000.0)).otherwise(F.lit(1.0))
    fy = F.when(top > 1000, height).when(top > 1, F.lit(1000.0)).otherwise(F.lit(1.0))
    return unit_box(x1 / fx, y1 / fy, x2 / fx, y2 / fy)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share an area."""
    return (F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]))


def centre(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def nearby_boxes(a: Column, b: Column, dx: float = 0.15, dy: float = 0.12) -> Column:
    return (F.abs(centre(a)["x"] - centre(b)["x"]) <= dx) & (F.abs(centre(a)["y"] - centre(b)["y"]) <= dy)


def expanded_box(box: Column, margin: Column | float) -> Column:
    m = margin if isinstance(margin, Column) else F.lit(margin)
    return F.struct(
        F.greatest(F.lit(0.0), box["x1"] - m).alias("x1"), F.greatest(F.lit(0.0), box["y1"] - m).alias("y1"),
        F.least(F.lit(1.0), box["x2"] + m).alias("x2"), F.least(F.lit(1.0), box["y2"] + m).alias("y2"),
    )


def likely_subtitle(box: Column, least_width: float = 0.35) -> Column:
    """A wide box around the middle in the lower part."""
    c = centre(box)
    return (F.abs(c["x"] - 0.5) <= 0.2) & (c["y"] >= 0.55) & (box["x2"] - box["x1"] >= least_width)


def interval_gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Distance between two intervals, 0 if they overlap."""
    return F.greatest(F.lit(0).cast("double"), F.greatest(s1, s2) - F.least(e1, e2))


def midpoint(start: Column, end: Column) -> Column:
    return F.when(end.isNotNull(), (start + end) / 2).otherwise(start)


def finite(value: Column) -> Column:
    """DOUBLE, or NULL for a text that is no number, NaN and the infinities."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def sync_gate(confidence: Column, offset: Column, shift: int = 15, confident: float = 3.0, most: int = 6) -> Column:
    """'boundary' at the ends of the searched shift, else 'unreliable', 'flagged' or 'ok'; NULL values are 'unknown'."""
    return (
        F.when(confidence.isNull() | offset.isNull() | F.isnan(confidence), "unknown").when(F.abs(offset) >= shift, "boundary")
        .when(confidence < confident, "unreliable").when(F.abs(offset) > most, "flagged").otherwise("ok")
    )


def sync_score(confidence: Column, offset: Column) -> Column:
    """Logistic confidence damped by the offset, 0 to 100."""
    return 100 * (1 / (1 + F.exp(-confidence))) * F.exp(-F.abs(offset) / 3.0)


def duration_within(duration: Column, required: Column, mode: Column) -> Column:
    """Whether a duration meets an exact, minimum or maximum requirement within max(0.5 s, 5 %)."""
    slack = F.greatest(F.lit(0.5), required * 0.05)
    return (
        F.when(mode == "exact", F.abs(duration - required) <= slack).when(mode == "minimum", duration >= required - slack).when(mode == "maximum", duration <= required + slack)
    )


def resolution_meets(width: Column, height: Column, short: Column, long: Column) -> Column:
    """Sides compared by length, whatever the orientation."""
    return (F.least(width, height) >= short) & (F.greatest(width, height) >= long)
