"""One-class SVM with an RBF kernel over all rows of a table, repeated rows counted.

Rows inside add nothing to the SVM, so only those outside or near the margin need be fitted to. A model of some rows tells which
those may be (`looked`): all that aren't inside by more than its doubt. Another pass over all rows then holds the rest against the
solution; if one of them isn't inside, by the root of NEAR at least, it and its like are fitted to as well.

The kernel is written in a basis: rows of the table such that the feature of no row that is fitted to is further than the root of
NEAR from their span, so that all kernel values, and decision values with them, are exact to NEAR. A row left out could err by that
root at most, by which it is inside. The basis is grown until a pass finds none further away. Its size depends on the kernel and
the columns, not on the number of rows.

In the basis the SVM has one weight for each of its rows. A pass adds up the rows that are outside by more than a margin, and brings
those within it to the driver, which solves for them exactly. A solution is one for all rows if no row that lay beyond the margin
has left its side, which the next pass tells; rows that have are solved for as well then. Where the margin holds too many rows, some
of them stand for the others once, for a better margin, never for the solution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isfinite, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .forest import squared_distances

#: How exact kernel values are; how exact the solution is, as the width in which a row at the margin may lie.
NEAR, WIDTH = 5e-6, 1e-6
#: Rows that are worked on at once; basis rows that are tried at once, and those that a task adds in a pass; rows of a margin that
#: are solved for on the driver; rows that are held against the basis at once.
AT_ONCE, STEP, ADDED, MARGIN = 256, 128, 128, 1 << 13
SIEVED = 2048
#: How many times more rows each model is of than the one before.
MORE, LEVELS = 16, 64


def kernel(y: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """Of each row of y with each of z."""
    a, b = y - z.mean(0), z - z.mean(0)
    left = np.column_stack([2 * gamma * a, -gamma * (a * a).sum(1), np.ones(len(a))])
    out = left @ np.column_stack([b, np.ones(len(b)), -gamma * (b * b).sum(1)]).T
    np.minimum(out, 0, out=out)
    return np.exp(out, out=out)


@dataclass(frozen=True)
class Basis:
    rows: np.ndarray
    inverse: np.ndarray  # of the Cholesky factor of the rows' kernel
    gamma: float

    def features(self, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(y), len(self.rows)))
        for at in range(0, len(y), AT_ONCE):
            np.matmul(kernel(y[at : at + AT_ONCE], self.rows, self.gamma), self.inverse.T, out=out[at : at + AT_ONCE])
        return out

    def beyond(self, y: np.ndarray, near: float = NEAR) -> np.ndarray:
        """Places of rows further than near. The first of the basis tell for most rows that they aren't."""
        places, left = np.arange(len(y)), np.ones(len(y))
        values = np.zeros((len(y), 0))
        for at in range(0, len(self.rows), STEP):
            upto = min(at + STEP, len(self.rows))
            values = np.concatenate([values, kernel(y[places], self.rows[at:upto], self.gamma)], 1)
            left = left - ((values @ self.inverse[at:upto, :upto].T) ** 2).sum(1)
            stay = left > near
            places, left, values = places[stay], left[stay], values[stay]
        return places

    def grown(self, y: np.ndarray, most: int | None = None, near: float = NEAR) -> Basis:
        """With rows of y, the furthest first, until none is further than near, or with `most` of them."""
        y = y[self.beyond(y, near)]
        if not len(y):
            return self
        had = self.features(y)
        left = 1 - (had * had).sum(1)
        new, chosen = np.zeros((min(len(y), most or len(y), 512), len(y))), []
        while left.max() > near and len(chosen) < (most or len(y)):
            i, m = int(left.argmax()), len(chosen)
            if m == len(new):
                new = np.concatenate([new, np.zeros_like(new)])
            own = np.exp(-self.gamma * squared_distances(y, y[i : i + 1])[:, 0])
            new[m] = (own - had @ had[i] - new[:m, i] @ new[:m]) / sqrt(left[i])
            left = left - new[m] ** 2
            left[i] = 0
            chosen.append(i)
        k, m, old = len(chosen), len(self.rows), had[chosen]
        corner = np.linalg.inv(np.tril(new[:k, chosen].T))
        inverse = np.zeros((m + k, m + k))
        inverse[:m, :m], inverse[m:, :m], inverse[m:, m:] = self.inverse, -corner @ old @ self.inverse, corner
        return Basis(np.concatenate([self.rows, y[chosen]]), inverse, self.gamma)


@dataclass(frozen=True)
class Svm:
    """first, rest: the weights of the first rows of the basis alone, and how long the weights are elsewhere. No feature is longer
    than 1, so that decision values are no further than rest from what the first rows give. That is worked out in numbers of 32 bits,
    and how far those may be wrong for each row."""

    rows: np.ndarray
    weights: np.ndarray
    rho: float
    gamma: float
    first: np.ndarray
    rest: float

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Decision values (below 0: outside)."""
        return np.concatenate([kernel(y[at : at + AT_ONCE], self.rows, self.gamma) @ self.weights for at in range(0, len(y), AT_ONCE)] or [np.zeros(0)]) - self.rho

    def below(self, y: np.ndarray, limit: float) -> np.ndarray:
        """Which rows' decision values are below the limit. The first rows of the basis tell for most that theirs aren't."""
        out = np.zeros(len(y), bool)
        middle, first = self.rows[: len(self.first)].mean(0), self.first.astype(np.float32)
        b = self.rows[: len(self.first)] - middle
        square = (b * b).sum(1)
        right = np.column_stack([b, np.ones(len(b)), -self.gamma * square]).T.astype(np.float32)
        for at in range(0, len(y), SIEVED):
            part = y[at : at + SIEVED]
            with np.errstate(all="ignore"):  # what is too large for 32 bits is told below
                a = part - middle
                own = (a * a).sum(1)
                values = np.column_stack([2 * self.gamma * a, -self.gamma * own, np.ones(len(a))]).astype(np.float32) @ right
                least = np.exp(values, out=values) @ first - np.float64(self.rho) - self.rest - noise(self.first, self.gamma, own + square.max(), y.shape[1])
            left = np.flatnonzero(~(least >= limit))
            out[at + left] = self.distances(part[left]) < limit
        return out


def noise(weights: np.ndarray, gamma: float, squares: np.ndarray | float, k: int) -> np.ndarray | float:
    """How far sums of kernel values in 32 bits may be wrong; squares: those of the lengths of a row and of the longest it meets."""
    return np.abs(weights).sum() * 2.0**-23 * ((k + 4) * 2 * gamma * squares + len(weights) + 8)


def svm_of(basis: Basis, w: np.ndarray, rho: float, some: np.ndarray, limit: float) -> Svm:
    """some, limit: rows that tell how many of the basis to begin with, for that limit; no result rests on them."""
    x, m = basis.features(some), len(w)
    rest = np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0))
    first = {j: basis.inverse[:j, :j].T @ w[:j] for j in [*range(STEP // 4, m, STEP // 4), m]}
    squares = 2 * ((some - some.mean(0)) ** 2).sum(1)
    costs = {j: j / 5 + m * (x[:, :j] @ w[:j] - rho - rest[j] - noise(v, basis.gamma, squares, some.shape[1]) < limit).mean() for j, v in first.items()}
    j = min(costs, key=costs.get)
    return Svm(basis.rows, basis.inverse.T @ w, rho, basis.gamma, first[j], float(rest[j]) + 1e-9)


def looked(counted: DataFrame, looks: list[tuple[Svm, float]], last: Svm | None = None) -> DataFrame:
    """Rows of counted that are below any look's limit; with last, the solution: those that it hasn't inside by the root of NEAR, of
    the rows below none of the limits."""
    shared, k = counted.sparkSession.sparkContext.broadcast((looks, last)), len(counted.columns) - 1

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks, last = shared.value
        for part in parts:
            if last:
                part = part[last.below(part.iloc[:, :k].to_numpy(float), sqrt(NEAR))]
            y = part.iloc[:, :k].to_numpy(float)
            found = np.zeros(len(y), bool)
            for svm, limit in looks:
                left = np.flatnonzero(~found)
                found[left] = svm.below(y[left], limit)
            yield part[found != bool(last)]

    return counted.mapInPandas(choose, counted.schema)


def solved(x: np.ndarray, most: np.ndarray, pull: np.ndarray, mass: float, start: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, float]:
    """w and rho that minimise |w|^2 / 2 - pull w - mass rho + sum of most * hinge(rho - x w): Newton steps, the hinge rounded over
    ever smaller widths, the last of them `width`; for each w the best rho is looked up."""

    def at(w: np.ndarray, width: float):
        f = x @ w
        lo, hi = f.min() - width, f.max() + width
        for _ in range(80):
            rho = (lo + hi) / 2
            if rho in (lo, hi):
                break
            lo, hi = (lo, rho) if most @ np.clip((rho - f) / width + 0.5, 0, 1) > mass else (rho, hi)
        t = rho - f
        share = np.clip(t / width + 0.5, 0, 1)
        hinge = np.where(share < 1, share**2 * width / 2, t)
        return w @ w / 2 - pull @ w - mass * rho + most @ hinge, rho, share

    w = start
    f = x @ w
    wide = max(width, float(np.diff(np.quantile(f, [0.02, 0.3]))[0]))
    while True:
        wide = max(wide / 4, width)
        value, rho, share = at(w, wide)
        for _ in range(200):
            slope = w - pull - (most * share) @ x
            zone = (share > 0) & (share < 1)
            xz, d = x[zone], most[zone] / wide
            if zone.any():
                xz = (xz - d @ xz / d.sum()) * np.sqrt(d)[:, None]  # rho follows w
            if len(xz) < x.shape[1]:
                step = -slope + xz.T @ np.linalg.solve(np.eye(len(xz)) + xz @ xz.T, xz @ slope)
            else:
                step = -np.linalg.solve(np.eye(x.shape[1]) + xz.T @ xz, slope)
            size, fall = 1.0, slope @ step
            if -fall < 1e-18:
                break
            while (new := at(w + size * step, wide))[0] > value + 1e-4 * size * fall and size > 1e-6:
                size /= 2
            if size <= 1e-6:
                break
            moved = np.abs(size * (x @ step)).max()
            w, (value, rho, share) = w + size * step, new
            if moved < width * 1e-3:
                break
        if wide == width:
            return w, rho


def level(distance: np.ndarray | float) -> np.ndarray:
    """Of a distance, by powers of the root of 2."""
    return np.clip(np.ceil(2 * np.log2(np.maximum(np.abs(distance), WIDTH) / WIDTH)), 0, LEVELS - 1).astype(int)


def grown_basis(counted: DataFrame, columns: list[str], basis: Basis) -> Basis:
    """The basis with more rows, for all rows of counted."""
    spark, k, schema = counted.sparkSession, len(columns), ", ".join(f"{c} double" for c in columns)
    rows = counted.select(*columns)
    while True:
        shared = spark.sparkContext.broadcast(basis)

        def beyond(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                y = part.to_numpy(float)
                yield part.iloc[np.concatenate([at + shared.value.beyond(y[at : at + SIEVED]) for at in range(0, len(y), SIEVED)] or [[]]).astype(int)]  # noqa: B023

        def further(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value  # noqa: B023
            had = len(own.rows)
            for part in parts:
                y = part.to_numpy(float)
                for at in range(0, len(y), SIEVED):
                    if len(own.rows) < had + ADDED:  # what is left over is seen in the next pass
                        own = own.grown(y[at : at + SIEVED], had + ADDED - len(own.rows))
            yield pd.DataFrame(own.rows[had:], columns=columns)

        rows = written(rows.mapInPandas(beyond, schema), "svm-rows")  # what a basis reaches, a larger one does
        found = rows.mapInPandas(further, schema).toPandas().to_numpy(float).reshape(-1, k)
        shared.destroy()
        if not len(found):
            return basis
        basis = basis.grown(found[np.lexsort(found.T)])


def fit(counted: DataFrame, columns: list[str], n: int, nu: float, sample: np.ndarray) -> Svm:
    """counted: different rows and how often each is there (n); n: rows in all. sample: rows to begin with, all equally likely; the
    result doesn't rest on them."""
    k, total = len(columns), n * len(columns)
    mean = counted.agg(F.sum(F.col("n") * sum((F.col(c) for c in columns), F.lit(0.0)))).first()[0] / total
    var = counted.agg(F.sum(F.col("n") * sum(((F.col(c) - mean) ** 2 for c in columns), F.lit(0.0)))).first()[0] / total
    if not isfinite(var):
        raise ValueError("columns with infinite values, or too large ones, can't be modelled")
    gamma = 1 / (k * max(var, 1e-12))
    sample = sample[:MARGIN]
    basis = Basis(sample[:1], np.ones((1, 1)), gamma).grown(sample)
    different = counted.count()
    if different <= MARGIN:
        basis = grown_basis(counted, columns, basis)
        rows = counted.select(*columns, "n").toPandas().sort_values(columns).to_numpy(float)
        x = basis.features(rows[:, :-1])
        w, rho = solved(x, rows[:, -1] / (nu * n), np.zeros(x.shape[1]), 1.0, x.mean(0))
        return svm_of(basis, w, rho, sample[:SIEVED], 0)
    x = basis.features(sample)
    even = lambda x: solved(x, np.full(len(x), 1 / (nu * len(x))), np.zeros(x.shape[1]), 1.0, x.mean(0), 1e-4)
    (w, rho), halves = even(x), [even(x[j::2]) for j in (0, 1)]
    f = x @ w - rho
    doubt = np.abs(np.subtract(*[x @ v - r for v, r in halves]))[f <= np.quantile(f, 2 * nu)].max()
    doubt, had, counts = max(doubt, WIDTH), len(x), level(f)
    counts = np.bincount(counts, minlength=LEVELS) / had  # shares of the rows; a pass tells the numbers
    del x, f
    counted, sizes = counted.select(*columns, "n"), [different]
    while sizes[0] >= 8 * MORE * MARGIN:
        sizes.insert(0, sizes[0] // MORE)
    for size in sizes:  # some of the rows first: the better the model, the fewer of all may be near its margin
        part, m = counted, n
        if size < different:
            part = counted.where(F.pmod(F.xxhash64(*columns, F.lit(13)), F.lit(1 << 32)) < int((1 << 32) * size / different))
            m = part.agg(F.sum("n")).first()[0]
        looks, limit = [], sqrt(NEAR) + 2 * doubt
        while not looks or size == different and looked(part, looks, svm).count():
            looks.append((svm_of(basis, w, rho, sample[:SIEVED], limit), limit))
            near = written(looked(part, looks), "svm-near")
            basis = grown_basis(near, columns, basis)
            w = np.append(w, np.zeros(len(basis.rows) - len(w)))
            w, rho = _fitted(near, columns, basis, m, nu, (w, rho), doubt, doubt * sqrt(nu * had), counts * size)
            svm = svm_of(basis, w, rho, sample[:SIEVED], sqrt(NEAR))
        doubt, had = max(doubt * sqrt(had / size), WIDTH), size
    return svm


def _fitted(
    counted: DataFrame, columns: list[str], basis: Basis, n: int, nu: float, centre: tuple, margin: float, per_doubt: float, counts: np.ndarray
) -> tuple[np.ndarray, float]:
    """w and rho of the rows in counted, all others being inside."""
    best, tries, room = None, [], MARGIN
    while True:
        kept = 1.0 if tries else min(1.0, room / max(1, counts[: level(margin) + 1].sum()))
        changed, outside, hinge, counts, pull, rows = _pass(counted, columns, basis, centre, margin, kept, tries)
        if tries and not changed:
            return tries[-1]
        value, mass, most = centre[0] @ centre[0] / 2 - centre[1] + hinge / (nu * n), 1 - outside / (nu * n), rows[:, -1] / (nu * n)
        if best is None or value < best[0]:
            best = value, centre
        if centre is not best[1] or not 0 < mass < most.sum():  # the margin was too small, or too few rows stood for it
            centre, margin, tries, room = best[1], 4 * margin, [], 2 * room
            continue
        found = solved(basis.features(rows[:, :-1]), most, pull / (nu * n), mass, (tries or [centre])[-1][0])
        if kept < 1:
            noise = sqrt((most**2).sum() * (1 - kept))
            centre, margin = found, max(min(margin / 2, per_doubt * noise), 2 * WIDTH)
        elif len(rows) <= 2 * room:
            tries.append(found)
        else:
            centre, tries = found, []


def _pass(
    counted: DataFrame, columns: list[str], basis: Basis, centre: tuple, margin: float, kept: float, tries: list[tuple]
) -> tuple[int, float, float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows are beyond the margin of centre, outside or inside, and on that side in all tries, or else on neither. Gives how many the
    last try has brought to neither; how many are outside; what all rows come to below the centre; different rows by the level of their
    distance to it; the sum of the features of those outside; and those on neither side, or the share kept of them, with what each stands for."""
    k, m = len(columns), len(basis.rows)
    models = np.column_stack([basis.inverse.T @ w for w, _ in [centre, *tries]]), np.array([rho for _, rho in [centre, *tries]])
    shared = counted.sparkSession.sparkContext.broadcast((basis.rows, basis.gamma, *models))
    limit = 1 << 32

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, gamma, weights, rhos = shared.value
        changed, outside, hinge, counts, pull = 0, 0.0, 0.0, np.zeros(LEVELS), np.zeros(m)
        for whole in parts:
            for at in range(0, len(whole), AT_ONCE):
                part = whole.iloc[at : at + AT_ONCE]
                y, copies = part.iloc[:, :k].to_numpy(float), part["n"].to_numpy(float)
                values = kernel(y, rows, gamma)
                f = values @ weights - rhos
                first = f[:, :1]
                left = ((first > margin) & (f[:, 1:] < WIDTH / 2)) | ((first < -margin) & (f[:, 1:] > -WIDTH / 2))
                neither = (np.abs(first[:, 0]) <= margin) | left.any(1)
                changed += int((left[:, -1] & ~left[:, :-1].any(1)).sum()) if len(rhos) > 1 else 0
                out = (first[:, 0] < 0) & ~neither
                outside += copies[out].sum()
                counts += np.bincount(level(first[:, 0]), minlength=LEVELS)
                hinge += copies @ np.maximum(-first[:, 0], 0)
                pull += copies[out] @ values[out]
                neither &= part["spread"].to_numpy() < kept * limit
                if neither.any():
                    packed = np.column_stack([y[neither], copies[neither] / kept])
                    yield pd.DataFrame({"sums": False, "data": [np.ascontiguousarray(packed, float).tobytes()]})
        yield pd.DataFrame({"sums": True, "data": [np.concatenate([[changed, outside, hinge], counts, pull]).tobytes()]})

    spread = F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(limit)).alias("spread")
    found = counted.select(*columns, "n", spread).mapInPandas(look, "sums boolean, data binary").collect()  # m numbers a task, and the margin
    shared.destroy()
    sums = sum((np.frombuffer(r["data"]) for r in found if r["sums"]), np.zeros(m + 3 + LEVELS))
    rows = [np.frombuffer(r["data"]).reshape(-1, k + 1) for r in found if not r["sums"]]
    rows = np.concatenate(rows) if rows else np.zeros((0, k + 1))
    return int(sums[0]), sums[1], sums[2], sums[3 : 3 + LEVELS], basis.inverse @ sums[3 + LEVELS :], rows[np.lexsort(rows.T)]

