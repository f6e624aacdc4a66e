"""Unsupervised detectors in numpy: isolation forest, local outlier factor, one-class SVM; a column's forest over all its values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered

#: Values that a forest of one column is grown from, its trees, and the values of a tree.
SAMPLE, TREES, SUBSAMPLE = 4096, 100, 256


def usual_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, most: int, random: np.random.Generator):
    lo, hi = x.min(0), x.max(0)
    free = np.flatnonzero(hi > lo)
    if depth >= most or len(x) <= 1 or not len(free):
        return depth + usual_depth(len(x))
    column = int(random.choice(free))
    cut = random.uniform(lo[column], hi[column])
    left = x[:, column] <= cut
    return column, cut, _grow(x[left], depth + 1, most, random), _grow(x[~left], depth + 1, most, random)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, a row a tree: a node's children stand at 2 * node + 1 and 2 * node + 2, and all leaves at the last level
    (one that ends above it has nodes below that all lead left). So all rows walk as many steps, without a look at the tree."""

    columns: np.ndarray  # trees, inner nodes
    cuts: np.ndarray
    depths: np.ndarray  # trees, leaves
    usual: float

    @property
    def levels(self) -> int:
        return self.depths.shape[1].bit_length() - 1


def grow_forest(x: np.ndarray, trees: int, seed: int = 42, dealt: bool = False) -> Forest:
    """Each tree draws its rows from x; if x is dealt, it holds the trees' rows one after another."""
    random = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(x))
    most = ceil(log2(max(size, 2)))
    columns, cuts, depths = np.zeros((trees, 2**most - 1), np.intp), np.full((trees, 2**most - 1), np.inf), np.zeros((trees, 2**most))

    def put(t: int, node: int, level: int, tree) -> None:
        if not isinstance(tree, tuple):
            depths[t, (node + 1 << most - level) - 2**most] = tree  # the leftmost leaf below
            return
        columns[t, node], cuts[t, node] = tree[:2]
        put(t, 2 * node + 1, level + 1, tree[2])
        put(t, 2 * node + 2, level + 1, tree[3])

    for t in range(trees):
        rows = slice(t * size, (t + 1) * size) if dealt else random.choice(len(x), size, replace=False)
        put(t, 0, 0, _grow(x[rows], 0, most, random))
    return Forest(columns, cuts, depths, usual_depth(size))


def isolation_scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean depth / usual depth): near 1 for values that are soon alone. A tree is walked by all rows together."""
    flat, rows, total = np.ascontiguousarray(x, float).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for columns, cuts, depths in zip(forest.columns, forest.cuts, forest.depths, strict=True):
        node = np.zeros(len(x), np.intp)
        for _ in range(forest.levels):
            node = 2 * node + 1 + (flat[rows + columns[node]] > cuts[node])
        total += depths[node - len(cuts)]
    return 2 ** (-total / len(forest.cuts) / max(forest.usual, 1e-9))


def score_steps(forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """A forest of one column gives steps: values up to the first end have the first score, up to the second the second, ..."""
    ends = np.append(np.unique(forest.cuts[np.isfinite(forest.cuts)]), np.inf)
    return ends, isolation_scores(forest, ends[:, None])


def outlier_factors(x: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factors over k neighbours."""
    distance = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, 1, kind="stable")[:, :k]
    far = np.take_along_axis(distance, near, 1)
    density = 1 / (np.maximum(far[near, -1], far).mean(1) + 1e-10)
    return density[near].mean(1) / density


def squared_distances(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of y to each of x; exactly 0 between equal rows."""
    out = np.zeros((len(y), len(x)))
    for j in range(x.shape[1]):
        out += (y[:, j, None] - x[None, :, j]) ** 2
    return out


def fit_neighbours(x: np.ndarray, k: int):
    """For outlier factors of any rows: rows, k, their distance to the k-th neighbour, and density."""
    distance = np.sqrt(squared_distances(x, x))
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, 1, kind="stable")[:, :k]
    far = np.take_along_axis(distance, near, 1)
    return x, k, far[:, -1], 1 / (np.maximum(far[near, -1], far).mean(1) + 1e-10)


#: Rows beside the neighbours that are wanted whose distances are worked out exactly; rows whose neighbours are looked for at once.
SPARE, AT_ONCE = 8, 1024


def nearest(x: np.ndarray, y: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of x nearest to each row of y, in any order, and their distances. A product of matrices finds rows that may be
    near; exact distances decide among them, and for all rows where the product's rounding leaves a doubt. skip: rows of y that
    are in x as well, and leave out one row equal to them."""
    middle = x.mean(0)
    a, b = y - middle, x - middle
    own_square, squares = (a * a).sum(1), (b * b).sum(1)
    rough = squares[None] - 2 * (a @ b.T)  # less each row's own square, which all its distances have
    m = min(len(x), k + 1 + SPARE)
    order = np.argpartition(rough, m, 1)[:, : m + 1] if m < len(x) else np.broadcast_to(np.arange(len(x)), (len(y), len(x)))
    near = order[:, :m]
    exact = ((y[:, None] - x[near]) ** 2).sum(2)
    own = np.flatnonzero(skip)
    exact[own, exact[own].argmin(1)] = np.inf
    best = np.argpartition(exact, k - 1, 1)[:, :k]
    far = np.take_along_axis(exact, best, 1)
    if m < len(x):
        left_out, noise, most = np.take_along_axis(rough, order[:, m:], 1)[:, 0] + own_square, 1e-14 * (own_square + squares.max()), far.max(1)
        doubt = np.flatnonzero((left_out - noise < most) & (noise > 1e-9 * most) & (most > 0))
        if len(doubt):
            every = squared_distances(y[doubt], x)
            mine = np.flatnonzero(skip[doubt])
            every[mine, every[mine].argmin(1)] = np.inf
            some = np.argpartition(every, k - 1, 1)[:, :k]
            near = near.copy()
            near[doubt[:, None], best[doubt]] = some
            far[doubt] = np.take_along_axis(every, some, 1)
    return np.take_along_axis(near, best, 1), np.sqrt(far)


def outlier_factors_of(model, y: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Local outlier factors of any rows; one that is a member of the model's rows is no neighbour of its own."""
    x, k, last, density = model
    if len(y) > AT_ONCE:  # distances to all of x are to stay in a core's cache
        return np.concatenate([outlier_factors_of(model, y[at : at + AT_ONCE], member[at : at + AT_ONCE]) for at in range(0, len(y), AT_ONCE)])
    near, distance = nearest(x, y, k, member)
    reach = np.maximum(last[near], distance).mean(1)
    return density[near].mean(1) * (reach + 1e-10)


def fit_svm(x: np.ndarray, nu: float, steps: int = 2000):
    """A one-class SVM with an RBF kernel, by pairwise steps on the dual: rows, their weights and offset, the kernel's width,
    and what the rows themselves come to before the offset."""
    gamma = 1 / (x.shape[1] * max(x.var(), 1e-12))
    squares = (x**2).sum(1)
    kernel = np.exp(-gamma * np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0))
    n = len(x)
    most = 1 / (nu * n)
    alpha = np.zeros(n)
    alpha[: int(nu * n)] = most
    if int(nu * n) < n:
        alpha[int(nu * n)] = 1 - alpha.sum()
    gradient = kernel @ alpha
    for _ in range(steps):
        up, down = np.where(alpha < most - 1e-12, gradient, np.inf), np.where(alpha > 1e-12, gradient, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if down[j] - up[i] < 1e-5:
            break
        step = min((gradient[j] - gradient[i]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12), most - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        gradient += step * (kernel[:, i] - kernel[:, j])
    inside = (alpha > 1e-9) & (alpha < most - 1e-9)
    rho = gradient[inside].mean() if inside.any() else (gradient[alpha > 1e-9].max() + gradient[alpha <= 1e-9].min()) / 2 if (alpha <= 1e-9).any() else gradient.mean()
    return x, alpha, rho, gamma, gradient


def svm_distances(x: np.ndarray, nu: float, steps: int = 2000) -> np.ndarray:
    """Decision values of the rows that the SVM is fitted to (below 0: outside)."""
    _, _, rho, _, gradient = fit_svm(x, nu, steps)
    return gradient - rho


def svm_distances_of(model, y: np.ndarray) -> np.ndarray:
    """Decision values of any rows."""
    x, alpha, rho, gamma, _ = model
    used = alpha > 0
    return np.exp(-gamma * squared_distances(y, x[used])) @ alpha[used] - rho


def isolation_rate(series: Ordered) -> DataFrame:
    """series and isolation: the share of a column's values that an isolation forest sets apart.

    Forests are grown in tasks from a bounded sample of each column (SAMPLE values, by hash) and broadcast, a forest a column.
    A forest of one column has one score between two cuts: values are counted by such steps where they are, and the counts of
    all values, at most a row a step, give the threshold at the contamination.
    """
    spread = F.pmod(F.xxhash64("series", "i", F.lit(42)), F.lit(1_000_003)) / 1_000_003.0
    sample = series.rows.where(spread * F.col("n") < SAMPLE).select("series", "n", "i", "x")

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i").head(2 * SAMPLE)
        ends, scores = score_steps(grow_forest(part[["x"]].to_numpy(), TREES))
        return pd.DataFrame({"series": [key[0]], "ends": [ends], "scores": [scores]})

    grown = sample.groupBy("series").applyInPandas(grow, "series string, ends array<double>, scores array<double>").collect()  # a row a column
    shared = series.df.sparkSession.sparkContext.broadcast({r["series"]: np.array(r["ends"]) for r in grown})

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, rows in part.groupby("series", sort=False):
                steps, times = np.unique(np.searchsorted(shared.value[name], rows["x"].to_numpy(), side="left"), return_counts=True)
                yield pd.DataFrame({"series": name, "step": steps, "times": times})

    counted = series.values.select("series", "x").mapInPandas(place, "series string, step long, times long")
    counted = counted.groupBy("series", "step").agg(F.sum("times").alias("times"))
    scores = {r["series"]: np.array(r["scores"]) for r in grown}

    def rate(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        score, times = -scores[key[0]][part["step"].to_numpy()], part["times"].to_numpy()
        order = np.argsort(score)
        score, upto = score[order], np.cumsum(times[order])
        n = int(upto[-1])
        at = (n - 1) * min(0.15, max(0.02, 3 / n))
        low, high = score[np.searchsorted(upto, [np.floor(at), np.ceil(at)], side="right")]
        apart = score < low + (high - low) * (at - np.floor(at))
        return pd.DataFrame({"series": [key[0]], "isolation": [times[order][apart].sum() / n]})

    return counted.groupBy("series").applyInPandas(rate, "series string, isolation double")
