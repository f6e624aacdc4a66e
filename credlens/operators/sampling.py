"""Sampling integrity: repeated time stamps, uneven intervals, gaps, and sheets of different structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ramp_up
from .ordered import BLOCK, each_piece, ordered, quantiles
from .results import Reason, results

NO_TIME, FEW_TIMES = 18.0, 14.0


def intervals(df: DataFrame, time: str, block: int = BLOCK):
    """The positive intervals (seconds) between the distinct times of a column, and their count."""
    times = df.select(F.unix_micros(F.col(f"`{time}`").cast("timestamp")).alias("t")).where("t is not null").distinct()
    series = ordered(times, ["t"], ["t"], block)
    gaps = lambda p: {"seconds": (v := np.diff(p.since)[max(len(p.before) - 1, 0) :] / 1e6), "series": pa.repeat(p.series, len(v))}
    return each_piece(series, "series string, seconds double", gaps).where("seconds > 0"), series


def sampling(df: DataFrame, time: str | None, mismatch: float = 0.0, skipped: int = 0, block: int = BLOCK) -> DataFrame:
    """One result for the table. mismatch: share of columns that not all sheets have; skipped: empty sheets."""
    spark = df.sparkSession
    if time is None:
        rates = spark.range(1).select(F.lit("(table)").alias("series"), F.lit(0).alias("n"))
        values = {c: F.lit(None).cast("double") for c in ("repeats", "sd", "mean", "breaks", "slots", "longest")}
        rates = rates.select("*", *[v.alias(k) for k, v in values.items()])
    else:
        gaps, series = intervals(df, time, block)
        middle = quantiles(gaps, "seconds", [0.5], series.counts, block)
        slots = F.greatest(F.floor(F.col("seconds") / F.col("q0")) - 1, F.lit(0))
        sums = gaps.join(F.broadcast(middle), "series").agg(
            F.stddev_pop("seconds").alias("sd"), F.avg("seconds").alias("mean"), F.sum((F.col("seconds") > 3 * F.col("q0")).cast("long")).alias("breaks"),
            F.sum(slots).alias("slots"), F.max(slots).alias("longest"),
        )
        t = F.col(f"`{time}`").cast("timestamp")
        # distinct times are counted by the intervals' series; a table has one row here
        counted = df.agg(F.count(t).alias("n")).withColumn("repeats", 1 - F.try_divide(F.lit(sum(series.counts.values())), F.col("n")))
        rates = counted.join(F.broadcast(sums)).withColumn("series", F.lit("(table)"))
    few = F.col("n") < 4
    part = lambda value: F.when(few, 0.0).otherwise(value)
    missing = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return results(
        rates, "sampling",
        {
            "duplicate_timestamp_ratio": missing("repeats"), "interval_cv": F.coalesce(F.try_divide("sd", "mean"), F.lit(0.0)), "break_count": missing("breaks"),
            "estimated_missing_slots": missing("slots"), "longest_missing_run": missing("longest"),
            "sheet_structure_mismatch": F.lit(mismatch), "skipped_sheet_count": F.lit(skipped),
        },
        {
            "time_penalty": F.lit(NO_TIME) if time is None else F.when(few, FEW_TIMES).otherwise(0.0),
            "duplicate_penalty": part(ramp_up(F.col("duplicate_timestamp_ratio"), 0.01, 0.10, 22)),
            "interval_penalty": part(ramp_up(F.col("interval_cv"), 0.35, 1.20, 22)),
            "break_penalty": part(F.least(F.lit(18.0), F.col("break_count") * 4)),
            "missing_run_penalty": part(ramp_up(F.col("longest_missing_run"), 2, 12, 14)),
            "sheet_structure_penalty": ramp_up(F.col("sheet_structure_mismatch"), 0.20, 0.80, 14),
            "skipped_sheet_penalty": F.least(F.lit(8.0), F.col("skipped_sheet_count") * 3),
        },
        [
            # the reason for a missing time column is not among the top reasons, as it says nothing of the values
            Reason("No time column was found; intervals can't be checked.", F.lit(time is None), informational=True),
            Reason("There are too few time stamps to judge the intervals.", F.lit(time is not None) & (F.col("time_penalty") > 0)),
            Reason("Time stamps repeat.", F.col("duplicate_penalty") > 0),
            Reason("Intervals between samples vary much.", F.col("interval_penalty") > 0),
            Reason("There are clear breaks between samples.", F.col("break_penalty") > 0),
            Reason("A long run of samples seems to be missing.", F.col("missing_run_penalty") > 0),
            Reason("Sheets differ much in their columns.", F.col("sheet_structure_penalty") > 0),
            Reason("Empty sheets were skipped.", F.col("skipped_sheet_penalty") > 0),
        ],
    )


def structure_mismatch(df: DataFrame, sheet: str = "__sheet__") -> float:
    """1 - shared / all of the columns with values, over the sheets of a merged table."""
    if sheet not in df.columns:
        return 0.0
    has: list[Column] = [F.max(F.col(f"`{c}`").isNotNull()).alias(f"h{k}") for k, c in enumerate(df.columns) if c != sheet]
    sets = [{k for k, x in enumerate(row[1:]) if x} for row in df.where(F.col(sheet).isNotNull()).groupBy(sheet).agg(*has).collect()]  # a row a sheet
    sets = [s for s in sets if s]
    return 1 - len(set.intersection(*sets)) / max(len(set.union(*sets)), 1) if len(sets) > 1 else 0.0
