"""Labels of percentiles, their ordinals, and small scalar helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BucketScheme

UNKNOWN, OFF, MIDDLE, ON = "Unknown", "Risk-off", "Transitional", "Risk-on"


def _three(p: Column, low: float, high: float) -> Column:
    return F.when(p.isNull(), UNKNOWN).when(p <= F.lit(low), OFF).when(p >= F.lit(high), ON).otherwise(MIDDLE)


def tercile(p: Column) -> Column:
    return _three(p, 1.0 / 3.0, 2.0 / 3.0)


def asymmetric(p: Column) -> Column:
    return _three(p, 0.2, 0.8)


def quintile(p: Column) -> Column:
    out = F.when(p.isNull(), UNKNOWN)
    for i, edge in enumerate((0.2, 0.4, 0.6, 0.8), 1):
        out = out.when(p <= F.lit(edge), f"Q{i}")
    return out.otherwise("Q5")


def bucket(p: Column, scheme: BucketScheme) -> Column:
    """The label that a scheme gives; which one is chosen when the plan is built."""
    return {BucketScheme.TERCILE: tercile, BucketScheme.QUINTILE: quintile, BucketScheme.ASYM_20_60_20: asymmetric}[scheme](p)


def ordinal(label: Column) -> Column:
    """1 to 3; Unknown counts as the middle, other labels as NULL."""
    return F.when(label == OFF, 1.0).when(label.isin(MIDDLE, UNKNOWN), 2.0).when(label == ON, 3.0)


def gap(a: Column, b: Column) -> Column:
    return F.abs(ordinal(a) - ordinal(b))


def finite_ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0, never infinite."""
    return F.try_divide(a, b)


def safe_log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); NULL where the ratio isn't positive or b is 0."""
    ratio = F.try_divide(a, b)
    return F.when(ratio > 0, F.log(ratio))


def series_id(country: Column, asset_class: Column) -> Column:
    return F.concat_ws("_", country, asset_class)


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def quarter_end(date: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))


def rgba(color: str, alpha: float) -> str:
    """#rrggbb as an rgba() of CSS."""
    r, g, b = bytes.fromhex(color.removeprefix("#"))
    return f"rgba({r}, {g}, {b}, {alpha})"
