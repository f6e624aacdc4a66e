"""Ensemble anomaly check: isolation forest, local outlier factor and one-class SVM.

All rows are scaled by the medians and quartiles of all. The models are those of all rows: each tree of the forest draws its
SUBSAMPLE rows, as the algorithm has it, from all of them; neighbours are looked for among all (`neighbours`), and the SVM is fitted
to all (`support`). All rows are scored, equal ones once, and thresholds are quantiles of all rows' scores. A table of up to ROWS
rows is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, expm1, floor, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, ramp_down, ramp_up
from ..functions.tables import written
from . import neighbours, support
from .forest import SUBSAMPLE, grow_forest, isolation_scores, outlier_factors, svm_distances
from .ordered import BLOCK, quantiles
from .results import Reason, results

ROWS, LEAST_ROWS, LEAST_FEATURES, TREES = 800, 20, 2, 160
#: Rows that are scored at once; bins of a pass when a score is looked up by rank; how exact SVM decision values are.
AT_ONCE, BINS, EXACT = 4096, 1024, 1e-5


def features(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], int]:
    """The columns with values enough (of 40 % of the rows, 10 at least, 3 different), rows that have any of them, and how
    many rows those are. Whether there are three different values shows from the least, the greatest and one between."""
    kinds = dict(df.dtypes)
    rows = df.select(*[numeric(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns])
    ends = rows.agg(F.count("*").alias("_n"), *[f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    between = rows.agg(F.count("*").alias("_n"), *[F.max(((F.col(f"`{c}`") != ends[f"lo{i}"]) & (F.col(f"`{c}`") != ends[f"hi{i}"])).cast("int")).alias(f"b{i}") for i, c in enumerate(columns) if ends[f"lo{i}"] is not None]).first()
    good = [c for i, c in enumerate(columns) if ends[f"n{i}"] >= max(10, int(ends["_n"] * 0.4)) and between[f"b{i}"] and ends[f"lo{i}"] < ends[f"hi{i}"]]
    if not good:
        return rows.limit(0), [], 0
    rows = rows.select(*[f"`{c}`" for c in good]).dropna(how="all")
    return rows, good, rows.count()


def column_quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], n: int, block: int) -> list[list[float]]:
    """The columns' exact quantiles, nulls left out."""
    each = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("series"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)]))
    found = quantiles(rows.select(each.alias("e")).select("e.series", "e.x"), "x", shares, {str(i): n for i in range(len(columns))}, block)
    got = {int(r["series"]): [r[f"q{k}"] for k in range(len(shares))] for r in found.collect()}  # a row a column
    return [got[i] for i in range(len(columns))]


def robust_scale(rows: DataFrame, columns: Sequence[str], n: int | None = None, block: int = BLOCK) -> DataFrame:
    """Columns with gaps filled by the median, minus the median, by the interquartile range (of the filled column; 1 if 0).
    n: how many rows there are, if known. Quantiles of more than block rows need no task that reads a column's values."""
    if n is None:
        n = rows.count()
    if n > block:
        there = rows.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
        found = column_quantiles(rows, columns, [0.25, 0.5, 0.75], n, block)
        middle, ends = [q[1] for q in found], [[q[0], q[2]] for q in found]
    else:
        one = rows.agg(*[F.median(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]).first()
        middle = [one[f"m{i}"] for i in range(len(columns))]
    filled = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(middle[i])).alias(c) for i, c in enumerate(columns)])
    if n > block:
        if gaps := [i for i in range(len(columns)) if there[f"n{i}"] < n]:  # the medians that fill them move the quartiles
            for i, q in zip(gaps, column_quantiles(filled, [columns[i] for i in gaps], [0.25, 0.75], n, block), strict=True):
                ends[i] = q
    else:
        one = filled.agg(*[F.percentile(f"`{c}`", F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        ends = [one[f"q{i}"] for i in range(len(columns))]
    width = [(q[1] - q[0]) or 1.0 for q in ends]
    return filled.select(*[((F.col(f"`{c}`") - middle[i]) / width[i]).alias(c) for i, c in enumerate(columns)])


def sample_counts(counted: DataFrame, k: int, n: int, size: int) -> dict[tuple[float, ...], int]:
    """How often each row is in a sample of `size` of the n rows: all rows are equally likely, repeated ones too, whatever the
    partitions. counted: the k columns x0, x1, ... of different rows, and their count n.

    First each row is taken with probability p, for twice as many as are needed on average: the hash of a row's values decides
    whether any of its copies is. The driver draws how many those are (the first is at a geometric place, the others follow
    the binomial distribution), and `size` of the copies."""
    p = min(1.0, 2 * size / n)
    columns = [f"x{i}" for i in range(k)]
    if p < 1:
        spread = F.pmod(F.xxhash64(*columns, F.lit(42)), F.lit(1 << 52)) / float(1 << 52)
        counted = counted.where(spread < -F.expm1(F.col("n") * log1p(-p)))
    found = sorted(tuple(r) for r in counted.select(*columns, "n").collect())  # about 2 * size rows at most
    random = np.random.default_rng(42)
    taken = []
    for *_, copies in found:
        if p == 1:
            taken.append(copies)
        else:
            first = min(copies, max(1, ceil(log1p(random.random() * expm1(copies * log1p(-p))) / log1p(-p))))
            taken.append(1 + int(random.binomial(copies - first, p)))
    chosen = random.permutation(np.repeat(np.arange(len(found)), taken))[:size]
    places, times = np.unique(chosen, return_counts=True)
    return {found[i][:-1]: int(t) for i, t in zip(places, times, strict=True)}


def score_limits(scored: DataFrame, columns: Sequence[str], share: float, n: int) -> list[float]:
    """The quantile of all rows' scores in each column, by linear interpolation. The two scores that a quantile lies between are
    looked up by rank: counts by bins, then within the bin that holds a rank, until it holds one score; a pass serves all columns
    and ranks."""
    at = share * (n - 1)
    wanted = [(c, rank) for c in columns for rank in sorted({floor(at), ceil(at)})]
    ends = scored.agg(*[f(c).alias(f"{k}{c}") for c in columns for k, f in (("a", F.min), ("b", F.max))]).first()
    open_ = {w: (ends[f"a{w[0]}"], ends[f"b{w[0]}"], 0) for w in wanted}  # least and greatest score left, and the rows below
    while live := [w for w in wanted if open_[w][0] < open_[w][1]]:
        each = []
        for k, w in enumerate(live):
            lo, hi, _ = open_[w]
            width = (hi - lo) / BINS
            place = F.floor((F.col(w[0]) - lo) / width) if width > 0 else F.when(F.col(w[0]) == lo, 0).otherwise(1)
            each.append(F.when(F.col(w[0]).between(lo, hi), F.struct(F.lit(k).alias("k"), place.cast("long").alias("bin"), F.col(w[0]).alias("score"))))
        found = scored.select("n", F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("e"))
        bins = found.groupBy("e.k", "e.bin").agg(F.sum("n").alias("n"), F.min("e.score").alias("a"), F.max("e.score").alias("b")).orderBy("k", "bin").collect()  # BINS + 1 rows a rank at most
        for k, w in enumerate(live):
            below = open_[w][2]
            for r in (r for r in bins if r["k"] == k):
                if below + r["n"] > w[1]:
                    open_[w] = (r["a"], r["b"], below)
                    break
                below += r["n"]
    value = lambda c, rank: open_[c, rank][0]
    return [value(c, floor(at)) + (value(c, ceil(at)) - value(c, floor(at))) * (at - floor(at)) for c in columns]


def random_rows(counted: DataFrame, k: int, n: int, size: int) -> np.ndarray:
    """`size` of the n rows (all, if fewer) in random order."""
    sample = sample_counts(counted, k, n, size)
    x = np.repeat(np.array(list(sample), float).reshape(-1, k), list(sample.values()), 0)
    return np.random.default_rng(43).permutation(x)


def vote_on_all(scaled: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """METRICS, over all rows: one row."""
    k = len(columns)
    names = [f"x{i}" for i in range(k)]
    counted = written(scaled.toDF(*names).groupBy(*names).agg(F.count("*").alias("n")), "anomaly-rows")
    share = min(0.12, max(0.02, 8 / n))
    drawn = random_rows(counted, k, n, TREES * SUBSAMPLE)
    models = grow_forest(drawn, TREES, dealt=len(drawn) == TREES * SUBSAMPLE), support.fit(counted, names, n, share, drawn)
    shared = counted.sparkSession.sparkContext.broadcast(models)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, svm = shared.value
        for whole in parts:
            for at in range(0, len(whole), AT_ONCE):
                part = whole.iloc[at : at + AT_ONCE]
                y = part[names].to_numpy(float)
                yield part.assign(forest=-isolation_scores(forest, y), svm=svm.below(y, -EXACT))

    judged = counted.mapInPandas(score, ", ".join(f"{c} double" for c in names) + ", n long, forest double, svm boolean")
    factors = neighbours.factors(judged, names, max(1, min(20, max(5, int(n**0.5)), n - 1)), neighbours.tree_of(counted, names, counted.count()), ["n", "forest", "svm"])
    scored = written(factors.withColumn("factor", -F.col("factor")), "anomaly-scores")
    limits = score_limits(scored, ("forest", "factor"), share, n)
    flags = {m: F.col(m) < limit for m, limit in zip(("forest", "factor"), limits, strict=True)} | {"svm": F.col("svm")}
    votes = sum((f.cast("int") for f in flags.values()), F.lit(0))
    rate = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0)) / F.sum("n")
    rates = scored.agg(
        *[rate(f).alias(f"{m}_rate") for m, f in flags.items()], F.sum("n").cast("double").alias("rows"),
        rate(votes >= max(2, ceil(0.66 * len(flags)))).alias("consensus_rate"), rate((votes > 0) & (votes < len(flags))).alias("disagreement_rate"),
    )
    each = [F.col(f"{m}_rate") for m in flags]
    return rates.withColumns({"max_model_rate": F.greatest(*each), "rate_spread": F.greatest(*each) - F.least(*each)})


def vote(x: np.ndarray) -> dict[str, float]:
    n = len(x)
    share = min(0.12, max(0.02, 8 / n))
    k = max(1, min(20, max(5, int(n**0.5)), n - 1))
    scores = {"forest": -isolation_scores(grow_forest(x, TREES), x), "factor": -outlier_factors(x, k)}
    flags = {m: s < np.percentile(s, 100 * share) for m, s in scores.items()} | {"svm": svm_distances(x, share) < -EXACT}
    rates, votes = {m: float(f.mean()) for m, f in flags.items()}, sum(f.astype(int) for f in flags.values())
    needed = max(2, int(np.ceil(0.66 * len(flags))))
    return {f"{m}_rate": r for m, r in rates.items()} | {
        "rows": float(n), "consensus_rate": float((votes >= needed).mean()), "max_model_rate": max(rates.values()),
        "disagreement_rate": float(((votes > 0) & (votes < len(flags))).mean()), "rate_spread": max(rates.values()) - min(rates.values()),
    }


METRICS = ("forest_rate", "factor_rate", "svm_rate", "rows", "consensus_rate", "max_model_rate", "disagreement_rate", "rate_spread")


def anomaly(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One result for the table."""
    rows, good, n = features(df, columns) if columns else (df, [], 0)
    spark = df.sparkSession
    if n < LEAST_ROWS or len(good) < LEAST_FEATURES:
        one = spark.range(1).select(F.lit("(table)").alias("series"), F.lit(0).alias("n"))
        return results(one, "ml_anomaly", {}, {}, [], least=1, short=(55.0 if n < LEAST_ROWS else 58.0, "insufficient_data"))
    scaled = robust_scale(rows, good, n)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.to_numpy(float)
        return pd.DataFrame([vote(x[np.lexsort(x.T)])])[list(METRICS)]

    if n > ROWS:
        rates = vote_on_all(scaled, good, n)
    else:
        rates = scaled.groupBy().applyInPandas(run, ", ".join(f"{m} double" for m in METRICS))
    rates = rates.withColumns({"series": F.lit("(table)"), "n": F.col("rows").cast("long")})
    return results(
        rates, "ml_anomaly", {m: F.col(m) for m in METRICS},
        {
            "consensus_penalty": ramp_up(F.col("consensus_rate"), 0.08, 0.25, 35), "model_penalty": ramp_up(F.col("max_model_rate"), 0.20, 0.45, 18),
            "disagreement_penalty": ramp_up(F.col("disagreement_rate"), 0.35, 0.75, 12), "spread_penalty": ramp_up(F.col("rate_spread"), 0.12, 0.35, 10),
            "rows_penalty": ramp_down(F.col("rows"), 50, 20, 10),
        },
        [
            Reason("Several models agree on many anomalous rows.", F.col("consensus_penalty") > 0),
            Reason("One model finds very many anomalous rows.", F.col("model_penalty") > 0),
            Reason("The models disagree: treat their findings with care.", F.col("disagreement_penalty") > 0),
            Reason("There are few rows to model.", F.col("rows_penalty") > 0),
        ],
        attention=25,
    )
