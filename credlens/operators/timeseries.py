"""Natural time dependence: autocorrelation, turns and trend."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ramp_down, ramp_up
from .ordered import Ordered, Piece, each_piece
from .results import Reason, results

LEAST, LAGS = 12, 12


def products(p: Piece) -> dict[str, float]:
    """Products of the piece's values, less the mean, with those before them; turns; places against values."""
    away, k = p.since - p.of.mean, len(p.before)
    own, i = away[k:], p.at + np.arange(len(p.x)) - (p.of.n - 1) / 2
    sign = np.sign(np.diff(p.since)[max(k - 2, 0) :])
    lags = {f"c{lag}": float(own[max(lag - k, 0) :] @ away[max(k - lag, 0) : max(len(away) - lag, 0)]) for lag in range(1, LAGS + 1)}
    return lags | {"square": own @ own, "turns": int((sign[1:] != sign[:-1]).sum()), "ii": i @ i, "ix": i @ own}


def timeseries(series: Ordered) -> DataFrame:
    names = [f"c{k}" for k in range(1, LAGS + 1)]
    parts = each_piece(series, "series string, at long, " + ", ".join(f"{c} double" for c in names) + ", square double, turns long, ii double, ix double", products)
    known = series.df.sparkSession.createDataFrame(list(series.counts.items()), "series string, n long")
    sums = parts.groupBy("series").agg(*[F.sum(c).alias(c) for c in (*names, "square", "turns", "ii", "ix")]).join(F.broadcast(known), "series")
    acf = [F.when(F.col("n") >= 2 * k, F.try_divide(f"c{k}", "square")).alias(f"acf_lag{k}") for k in range(1, LAGS + 1)]
    trend = F.try_divide(F.col("ix"), F.sqrt("ii") * F.sqrt("square"))
    rates = sums.select("series", "n", *acf, "turns", F.abs(trend).alias("trend"))
    high = F.greatest(*[F.abs(f"acf_lag{k}") for k in range(2, LAGS + 1)])
    return results(
        rates, "timeseries",
        {f"acf_lag{k}": F.col(f"acf_lag{k}") for k in range(1, LAGS + 1)}
        | {
            "sign_change_rate": F.coalesce("turns", F.lit(0)) / F.greatest(F.col("n") - 2, F.lit(1)),
            "trend_strength": F.col("trend"),
            "high_order_acf_max": high,
        },
        {
            "acf_lag1_high_penalty": ramp_up(F.col("acf_lag1"), 0.98, 1, 22),
            "acf_lag1_negative_penalty": ramp_down(F.col("acf_lag1"), -0.2, -1, 10),
            "sign_change_penalty": ramp_down(F.col("sign_change_rate"), 0.08, 0, 20),
            "linear_trend_penalty": F.least(ramp_up(F.col("trend_strength"), 0.97, 1, 18), ramp_down(F.col("sign_change_rate"), 0.18, 0, 18)),
            "high_order_acf_penalty": F.when(F.col("n") >= 20, ramp_down(F.col("high_order_acf_max"), 0.05, 0, 10)).otherwise(0.0),
        },
        [
            Reason("The lag-1 autocorrelation is close to 1: changes look mechanical.", F.col("acf_lag1_high_penalty") > 0),
            Reason("The lag-1 autocorrelation is clearly negative: values seem to alternate.", (F.col("acf_lag1_high_penalty") <= 0) & (F.col("acf_lag1_negative_penalty") > 0)),
            Reason("The direction hardly ever changes.", F.col("sign_change_penalty") > 0),
            Reason("The trend is nearly a perfect line.", F.col("linear_trend_penalty") > 0),
            Reason("Autocorrelations beyond lag 1 are all close to 0.", F.col("high_order_acf_penalty") > 0),
        ],
        least=LEAST,
    )
