"""Column expressions that the indicators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def clamp_score(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def ramp_up(value: Column, start: float, full: float, most: float) -> Column:
    """0 up to start, then linearly to most at full. Null gives most, as an undefined metric is a finding."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - start) / (full - start))) * most


def ramp_down(value: Column, start: float, full: float, most: float) -> Column:
    """0 from start on, linearly to most at full below it. Null gives most."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(start) - value) / (start - full))) * most


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def numeric(column: Column, kind: str) -> Column:
    """A column of that Spark type as a double; what isn't a number, and NaN, is null. Time stamps and dates are no numbers."""
    if kind == "string":
        text = F.trim(column)
        parsed = F.when(~text.rlike("(?i)[0-9.][df]$"), text.try_cast("double"))
    elif kind in ("timestamp", "timestamp_ntz", "date") or kind.startswith(("array", "map", "struct", "binary")):
        return F.lit(None).cast("double")
    else:
        parsed = column.cast("double")
    return F.nullif(parsed, F.lit(NAN))


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "low").when(score >= 50, "medium").otherwise("high")


def risk_flag(penalty: Column, attention: float = 30) -> Column:
    return F.when(penalty < attention, "ok").otherwise("attention")


def safe_filename_part(text: object) -> str:
    """At most 80 characters that every file system takes."""
    return re.sub(r"[^\w.-]+", "_", str(text)).strip("_")[:80] or "unnamed"
