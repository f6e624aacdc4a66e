"""Change points: window shift, CUSUM and Page-Hinkley, piece by piece."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ramp_up
from .drift import of_series, positive_sd, scale
from .ordered import Ordered, Piece, each_piece, earlier
from .results import Reason, results

LEAST, DELTA = 20, 0.005


def window_of(n: int) -> int:
    return min(max(5, n // 6), 20)


def curves(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """CUSUM and the Page-Hinkley sum, from what they came to before the piece. The running mean is the mean and CUSUM's share."""
    away = p.x - p.of.mean
    upto = lambda start, v: np.cumsum(np.concatenate([[start], v]))[1:]
    cusum = upto(p.known["cusum0"], away)
    return cusum, upto(p.known.get("ph0", 0.0), away - cusum / (p.at + 1 + np.arange(len(away))) - DELTA * positive_sd(p.of))


def shifts(p: Piece) -> np.ndarray:
    """Of each value: how far means of the windows before and from it on are apart, as a share of the scale; -1 near the ends."""
    n, w, k = p.of.n, window_of(p.of.n), len(p.before)
    near = np.concatenate([p.before, p.x, p.after])
    first, last = max(w - p.at, 0), min(len(p.x), n - w - p.at + 1)
    out = np.full(len(p.x), -1.0)
    if first < last:
        mean = lambda start: sum(near[k + start + j : k + start + j + last - first] for j in range(w)) / w  # noqa: E731  in order, so that equal windows tie
        out[first:last] = np.abs(mean(first) - mean(first - w)) / scale(p.of)
    return out


def extremes(p: Piece) -> dict[str, float]:
    """The greatest values, and where they first are; what the sums come to."""
    cusum, ph = curves(p)
    risen = ph - np.minimum.accumulate(ph)
    out = {"total": cusum.sum(), "ph_total": ph[-1], "ph_low": ph.min()}
    for name, v in (("shift", shifts(p)), ("high", cusum), ("low", -cusum), ("risen", risen), ("top", ph)):
        out |= {name: v.max(), f"{name}_i": p.at + int(v.argmax())}
    return out


def before(series: Ordered) -> DataFrame:
    """cusum0: CUSUM before each piece."""
    return series.pieces.select("series", "at", F.coalesce(earlier(F.col("s")), F.lit(0.0)).alias("cusum0"))


def found_before(parts: DataFrame) -> DataFrame:
    """parts with ph0 and low0: the Page-Hinkley sum before each piece, and its least value, at most 0."""
    parts = parts.withColumn("ph0", F.coalesce(earlier(F.col("ph_total")), F.lit(0.0)))
    return parts.withColumn("low0", F.least(F.lit(0.0), earlier(F.col("ph0") + F.col("ph_low"), F.min)))


EXTREMES = "series string, at long, total double, ph_total double, ph_low double, " + ", ".join(f"{c} double, {c}_i long" for c in ("shift", "high", "low", "risen", "top"))


def features(series: Ordered) -> DataFrame:
    """A row for each value: its window's shift ratio, CUSUM, and Page-Hinkley statistic. A task goes through a series of one
    block in order."""
    short, known = series.blocks <= 1, None
    if not short:
        start = before(series)
        known = found_before(each_piece(series, EXTREMES, extremes, start)).select("series", "at", "ph0", "low0").join(start, ["series", "at"])
    last: dict[str, dict[str, float]] = {}  # a short series' sums so far

    def run(p: Piece) -> dict:
        if short:
            p = replace(p, known=last.get(p.series, {"cusum0": 0.0, "ph0": 0.0, "low0": 0.0}))
        cusum, ph = curves(p)
        shift, low = shifts(p), np.minimum(np.minimum.accumulate(ph), p.known["low0"])
        stat = ph - low
        last[p.series] = {"cusum0": cusum[-1], "ph0": ph[-1], "low0": low[-1]}
        return {"series": pa.repeat(p.series, len(ph)), "i": p.at + np.arange(len(ph)), "x": p.x, "shift": pa.array(shift, mask=shift < 0), "cusum": cusum, "ph_stat": stat}

    return each_piece(series, "series string, i long, x double, shift double, cusum double, ph_stat double", run, known, in_order=short)


def changepoint(series: Ordered) -> DataFrame:
    parts = found_before(each_piece(series, EXTREMES, extremes, before(series))).join(F.broadcast(of_series(series)), "series")
    parts = parts.withColumn("middle", F.sum("total").over(Window.partitionBy("series")) / F.col("n"))
    at = lambda v, i: F.struct(v.alias("v"), (-F.col(i)).alias("i"))
    positive = lambda s: F.when(s["v"] > 0, s)
    parts = parts.withColumn("far", F.greatest(at(F.col("high") - F.col("middle"), "high_i"), at(F.col("low") + F.col("middle"), "low_i")))
    parts = parts.withColumn("ph", F.greatest(at(F.col("risen"), "risen_i"), at(F.col("ph0") + F.col("top") - F.col("low0"), "top_i")))
    rates = parts.groupBy("series").agg(
        F.first("n").alias("n"), F.first("sd").alias("spread"), (F.max("high") + F.max("low")).alias("cusum_range"),
        F.max(positive(at(F.col("shift"), "shift_i"))).alias("best"), F.max("far").alias("far"), F.max(positive(F.col("ph"))).alias("ph"),
    )
    index = {"best_window_index": -F.col("best.i"), "cusum_index": -F.col("far.i"), "page_hinkley_index": -F.col("ph.i")}
    points = F.array_sort(F.filter(F.array(*index.values()), lambda p: p.isNotNull()))
    n = F.size(points)
    median = (F.element_at(points, F.floor((n + 1) / 2).cast("int")) + F.element_at(points, F.floor(n / 2).cast("int") + 1)) / 2
    return results(
        rates, "changepoint",
        {
            "best_window_mean_shift_ratio": F.coalesce("best.v", F.lit(0.0)),
            "cusum_ratio": F.col("cusum_range") / (F.col("spread") * F.col("n")),
            "page_hinkley_ratio": F.coalesce("ph.v", F.lit(0.0)) / (F.col("spread") * F.sqrt("n")),
            **index, "likely_changepoint_index": F.when(n > 0, F.floor(median)),
        },
        {
            "sliding_mean_penalty": ramp_up(F.col("best_window_mean_shift_ratio"), 0.25, 0.80, 35),
            "cusum_penalty": ramp_up(F.col("cusum_ratio"), 0.18, 0.45, 25),
            "page_hinkley_penalty": ramp_up(F.col("page_hinkley_ratio"), 2.5, 5, 25),
        },
        [
            Reason("Means before and after some point differ much.", F.col("sliding_mean_penalty") > 0),
            Reason("The CUSUM curve moves far off.", F.col("cusum_penalty") > 0),
            Reason("The Page-Hinkley statistic is high.", F.col("page_hinkley_penalty") > 0),
        ],
        least=LEAST, short=(65.0, "limited"),
    )
