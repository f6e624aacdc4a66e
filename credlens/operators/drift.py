"""Sensor drift: slow shifts of level and spread."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ramp_up
from .ordered import Ordered, Piece, Stats, each_piece, earlier, moment_columns, moments, spread, with_means
from .results import Reason, results

LEAST, TINY = 20, 1e-9


def slope_window(n: int) -> int:
    return min(max(5, n // 8), 20)


def scale(of: Stats) -> float:
    return max(of.hi - of.lo, of.sd, TINY)


def positive_sd(of: Stats) -> float:
    return of.sd if of.sd > 0 else TINY


def of_series(series: Ordered) -> DataFrame:
    """series, n, scale and sd."""
    return series.df.sparkSession.createDataFrame([(k, s.n, scale(s), positive_sd(s)) for k, s in series.stats.items()], "series string, n long, scale double, sd double")


def sums(p: Piece) -> dict[str, float | None]:
    """Of the piece: values near the series' ends, means of windows against their places, the running sum's ends, signs of steps."""
    n, at, w = p.of.n, p.at, slope_window(p.of.n)
    end, i = max(5, n // 5), np.arange(p.at, p.at + len(p.x))
    total = np.cumsum(p.x - p.of.mean)
    away = np.concatenate([[0.0], np.cumsum(p.since - p.of.mean)])
    rolling = (away[w:] - away[:-w])[max(len(p.before) - w + 1, 0) :] / w
    place = np.arange(len(rolling)) + (at + len(p.x) - len(rolling)) - n / 2
    d = np.diff(p.since)[max(len(p.before) - 1, 0) :]
    return moments("head", p.x[i < end]) | moments("tail", p.x[i >= n - end]) | {
        "windows": len(rolling), "i": place.sum(), "r": rolling.sum(), "ii": (place * place).sum(), "ir": (place * rolling).sum(),
        "total": total[-1], "low": total.min(), "high": total.max(), "moves": int((d != 0).sum()), "signs": np.sign(d).sum(),
    }


def drift(series: Ordered) -> DataFrame:
    parts = each_piece(series, f"series string, at long, {moment_columns('head', 'tail')}, windows long, i double, r double, ii double, ir double, total double, low double, high double, moves long, signs double", sums)
    parts = with_means(parts.withColumn("upto", F.coalesce(earlier(F.col("total")), F.lit(0.0))), "head", "tail")
    rates = parts.groupBy("series").agg(
        F.first("a_head").alias("head"), F.first("a_tail").alias("tail"), spread("head", 0).alias("head_sd"), spread("tail", 0).alias("tail_sd"),
        *[F.sum(c).alias(c) for c in ("windows", "i", "r", "ii", "ir")],
        (F.max(F.col("upto") + F.col("high")) - F.min(F.col("upto") + F.col("low"))).alias("cusum"), F.try_divide(F.sum("signs"), F.sum("moves")).alias("sign"),
    )
    slope = F.try_divide(F.col("ir") - F.col("i") * F.try_divide("r", "windows"), F.col("ii") - F.col("i") * F.try_divide("i", "windows"))
    rates = rates.withColumn("slope", slope).join(F.broadcast(of_series(series)), "series")
    return results(
        rates, "drift",
        {
            "mean_shift_ratio": F.abs(F.col("tail") - F.col("head")) / F.col("scale"),
            "variance_shift_ratio": F.abs(F.col("tail_sd") - F.col("head_sd")) / F.col("sd"),
            "rolling_slope_ratio": F.abs(F.col("slope")) * (F.col("windows") - 1) / F.col("scale"),
            "cusum_range": F.col("cusum") / (F.col("sd") * F.col("n")),
            "sign_imbalance": F.coalesce(F.abs("sign"), F.lit(0.0)),
        },
        {
            "mean_shift_penalty": ramp_up(F.col("mean_shift_ratio"), 0.35, 1, 30),
            "rolling_slope_penalty": ramp_up(F.col("rolling_slope_ratio"), 0.30, 1, 25),
            "cusum_penalty": ramp_up(F.col("cusum_range"), 0.18, 0.45, 20),
            "variance_shift_penalty": ramp_up(F.col("variance_shift_ratio"), 0.60, 1.5, 15),
            "direction_penalty": ramp_up(F.col("sign_imbalance"), 0.80, 1, 10),
        },
        [
            Reason("The level at the end differs much from the level at the start.", F.col("mean_shift_penalty") > 0),
            Reason("The rolling mean climbs or falls steadily.", F.col("rolling_slope_penalty") > 0),
            Reason("Deviations from the mean add up in long runs.", F.col("cusum_penalty") > 0),
            Reason("The spread at the end differs much from the spread at the start.", F.col("variance_shift_penalty") > 0),
            Reason("Nearly all steps go in one direction.", F.col("direction_penalty") > 0),
        ],
        least=LEAST, short=(65.0, "limited"),
    )
