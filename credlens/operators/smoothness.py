"""Smoothness: how little a series varies from value to value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ramp_down, ramp_up, safe_ratio
from .ordered import Ordered, Piece, each_piece, moment_columns, moments, ranked, spread, with_means
from .results import Reason, results

LEAST = 8


def window_of(n: int) -> int:
    return min(7, max(3, n // 8))


def variances(p: Piece) -> np.ndarray:
    """Of the windows that end in the piece, step by step as Spark's and rounded, so that windows with the same values tie."""
    w, since = window_of(p.of.n), p.since
    if len(since) < w:
        return np.empty(0)
    mean = square = 0.0
    for k in range(w):
        v = since[max(len(p.before) - w + 1, 0) + k : len(since) - w + 1 + k]
        away = v - mean
        step = away / (k + 1)
        mean, square = mean + step, square + away * (away - step)
    found = square / (w - 1)
    return np.where(found < 2**53 / 1e12, np.floor(found * 1e12 + 0.5) / 1e12, found)


def steps(p: Piece) -> dict[str, float]:
    """Differences, second differences and relative changes of the piece's values."""
    since, k = p.since, len(p.before)
    d, dd, last = np.diff(since)[max(k - 1, 0) :], np.diff(since, 2)[max(k - 2, 0) :], since[max(k - 1, 0) : -1]
    change = since[max(k - 1, 0) + 1 :][last != 0] / last[last != 0] - 1
    return {"abs": float(np.abs(d).sum())} | moments("d", d) | moments("dd", dd) | moments("change", change)


def smoothness(series: Ordered) -> DataFrame:
    parts = with_means(each_piece(series, f"series string, at long, abs double, {moment_columns('d', 'dd', 'change')}", steps), "d", "dd", "change")
    rates = parts.groupBy("series").agg(
        F.try_divide(F.sum("abs"), F.sum("n_d")).alias("mean_abs"), F.first("a_d").alias("mean_d"), spread("d").alias("sd_d"), spread("dd").alias("sd_dd"),
        spread("change").alias("sd_change"), F.sum("n_change").alias("changes"),
    )
    windows = each_piece(series, "series string, variance double", lambda p: {"variance": (v := variances(p)), "series": pa.repeat(p.series, len(v))})
    low = {s: below / total for s, [(_, below, total)] in ranked(windows, "variance", [0.2]).items()}
    known = [(s, of.n, of.hi - of.lo, low.get(s)) for s, of in series.stats.items()]
    rates = rates.join(F.broadcast(series.df.sparkSession.createDataFrame(known, "series string, n long, range double, low_rate double")), "series")
    moves = F.col("range") > 0
    return results(
        rates, "smoothness",
        {
            "normalized_mean_abs_diff": safe_ratio(F.col("mean_abs"), F.col("range")),
            "diff_cv": safe_ratio(F.col("sd_d"), F.abs("mean_d") + 1e-9),
            "second_diff_std_ratio": safe_ratio(F.col("sd_dd"), F.col("range")),
            "low_rolling_variance_rate": F.coalesce("low_rate", F.lit(0.0)),
            "pct_change_std": F.when(F.col("changes") > 0, F.col("sd_change")).otherwise(0.0),
        },
        {
            "diff_penalty": ramp_down(F.col("normalized_mean_abs_diff"), 0.025, 0, 28),
            "diff_cv_penalty": ramp_down(F.col("diff_cv"), 0.35, 0, 24),
            "second_diff_penalty": F.when(moves, ramp_down(F.col("second_diff_std_ratio"), 0.001, 0, 24)).otherwise(0.0),
            "rolling_variance_penalty": ramp_up(F.col("low_rolling_variance_rate"), 0.45, 1, 16),
            "pct_change_penalty": F.when(moves, ramp_down(F.col("pct_change_std"), 0.01, 0, 12)).otherwise(0.0),
        },
        [
            Reason("Steps from value to value are very small against the whole range.", F.col("diff_penalty") > 0),
            Reason("Steps are nearly all of one size, without the usual random disturbance.", F.col("diff_cv_penalty") > 0),
            Reason("Second differences hardly vary; the series may be a drawn line.", F.col("second_diff_penalty") > 0),
            Reason("Many windows vary little.", F.col("rolling_variance_penalty") > 0),
            Reason("Relative changes are very even.", F.col("pct_change_penalty") > 0),
        ],
        least=LEAST,
    )
