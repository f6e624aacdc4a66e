"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

Entries become whole numbers x = floor(scale * c) + offset. What is fitted is each different vector of x once: its count n and sums
S are exact, and so are deviations n * x - S, from which rows are centred before anything is multiplied. The covariance is
never formed: each step is one distributed pass that multiplies it with a block of vectors. New blocks are orthogonalised twice
against all before; directions that vanish are replaced by random ones (breakdown); when too many vectors are held, the best
Ritz vectors are kept and the iteration goes on from them. It ends when all wanted residuals are at rounding level, or the whole
space is spanned. The trace comes from the deviations, and a last pass measures the covariance of the whitened rows, whose variances
put eigenvalues right that are small beside the largest.

The driver holds blocks of vectors as long as a row is wide, never rows. Vectors that are null, or hold a null or non-finite entry, or one
with |scale * c| of 2^53 or more, take no part. Vectors shorter than the longest count as 0 beyond their end. Repeated and null
ids are rows of their own. Components with an eigenvalue at rounding level (below 10^-12 of the largest) can't be whitened and are
left out; with fewer than two different vectors there are none, and the result is empty, as for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, released, slices, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Vectors of a block; vectors held before the iteration starts anew from the best; passes at most.
BLOCK, HELD, PASSES = 16, 256, 400
#: Residuals, as shares of the largest eigenvalue, at which a component counts as found; eigenvalues below which there is none.
RESIDUAL, NOTHING = 1e-13, 1e-12


def whole_numbers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    c = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v * float(scale)) >= float(1 << 53)))
    x = F.transform(c, lambda v: F.floor(v * float(scale)) + F.lit(offset).cast("long"))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sizes = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(sizes["most"]) - F.size("x"))))
    return rows


def _matrices(batches: Batches, wide: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for part in slices(batch, 4 << 20) if batch.num_rows else ():
            yield np.asarray(part.column("x").flatten(), np.int64).reshape(part.num_rows, wide)


def totals(rows: DataFrame, wide: int, size: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all rows of what `of` gives for a matrix of some of them: `size` numbers, added up in tasks and by Spark."""

    def run(batches: Batches) -> Batches:
        out = np.zeros(size, np.float64 if kind == "double" else np.int64)
        for x in _matrices(batches, wide):
            out += of(x)
        yield pa.RecordBatch.from_pydict({"place": np.arange(size), "value": out})

    found = rows.select("x").mapInArrow(released(run), f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size, found["value"].to_numpy().dtype if len(found) else np.float64)
    out[found["place"].to_numpy()] = found["value"].to_numpy()
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: whole numbers of 64 bits where they fit, Python's otherwise."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(d: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each row."""
    if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 >= 1 << 63:
        d = d.astype(object)
    return (d * d).sum(axis=1)


@dataclass(frozen=True)
class Whitening:
    """A fit: count and sums, unit eigenvectors as columns by falling eigenvalue, trace, and the measured error."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (deviations(x, self.n, self.sums) / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.eigenvalues)


def orthogonal(block: np.ndarray, basis: np.ndarray, wanted: int, rng: np.random.Generator) -> np.ndarray:
    """`wanted` unit vectors orthogonal to the basis and each other: those that the block adds, random ones where it adds none."""
    out: list[np.ndarray] = []
    queue = list(block.T)
    while len(out) < wanted:
        v = queue.pop(0) if queue else rng.standard_normal(len(basis))
        size = np.linalg.norm(v)
        for _ in range(2 if size else 0):
            held = np.column_stack([basis, *out])
            v = v - held @ (held.T @ v)
        if (left := np.linalg.norm(v)) > 1e-10 * size > 0:
            v = v / left
            held = np.column_stack([basis, *out])
            v = v - held @ (held.T @ v)
            out.append(v / np.linalg.norm(v))
    return np.column_stack(out)


def lanczos(times: Callable[[np.ndarray], np.ndarray], wide: int, wanted: int, block: int = BLOCK, held: int = HELD, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, and their unit vectors as columns, of the symmetric matrix that `times` multiplies with a block."""
    rng, wanted = np.random.default_rng(seed), min(wanted, wide)
    basis, image = np.zeros((wide, 0)), np.zeros((wide, 0))
    new = orthogonal(np.zeros((wide, 0)), basis, min(block, wide), rng)
    for _ in range(PASSES):
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        count = min(wanted, len(values))
        gap = np.linalg.norm(image @ inner[:, :count] - basis @ inner[:, :count] * values[:count], axis=0)
        if basis.shape[1] == wide or (len(values) >= wanted and gap.max() <= RESIDUAL * abs(values[0])):
            vectors = basis @ inner[:, :wanted]
            return values[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        last = image[:, -new.shape[1] :]
        if basis.shape[1] + block > max(held, wanted + 2 * block):  # goes on from the best, whose images are known
            keep = inner[:, : wanted + block]
            last = image @ keep[:, :wanted] - basis @ keep[:, :wanted] * values[:wanted]  # what they lack
            last = last[:, np.argsort(-gap)][:, :block]
            basis, image = basis @ keep, image @ keep
        new = orthogonal(last, basis, min(block, wide - basis.shape[1]), rng)
    raise ArithmeticError(f"eigenvectors not found within {PASSES} passes")


def fit(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The whitening of rows with x, all equally wide; None if there is no component."""
    different = written(rows.select("x").distinct(), "different")
    first = different.select(F.size("x").alias("wide")).first()
    n = different.count()
    if not first or not first["wide"] or n < 2:
        return None
    wide, low = first["wide"], (1 << 24) - 1
    parts = totals(different, wide, 2 * wide, lambda x: np.concatenate([(x >> 24).sum(axis=0), (x & low).sum(axis=0)]), "long")
    sums = [(int(a) << 24) + int(b) for a, b in zip(parts[:wide], parts[wide:], strict=True)]
    none = Whitening(n, sums, np.zeros((wide, 0)), np.zeros(0), 0.0)
    trace = float(totals(different, wide, 1, lambda x: np.array([float(squares(deviations(x, n, sums)).sum())]))[0]) / n / n / n
    if not trace:
        return None

    def times(vectors: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = none.centred(x)
            return (c.T @ (c @ vectors)).ravel()

        return totals(different, wide, vectors.size, product).reshape(vectors.shape) / n

    values, vectors = lanczos(times, wide, components, block)
    real = values > NOTHING * values[0]
    found = Whitening(n, sums, vectors[:, real], values[real], trace)
    k = int(real.sum())

    def spread(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    seen = totals(different, wide, k * k + k, spread) / n
    mean = seen[k * k :]
    cov = seen[: k * k].reshape(k, k) - np.outer(mean, mean)
    size = cov.diagonal()  # off 1 by the rounding of small eigenvalues, as a share of the largest: sums of squares know them better
    error = np.abs(cov / np.sqrt(np.outer(size, size)) - np.eye(k)).max()
    values = found.eigenvalues * size
    order = np.argsort(-values, kind="stable")
    return Whitening(n, sums, found.vectors[:, order], values[order], trace, float(error))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component (from 1), n, deviation (sum of (n * x - S)^2), whitened, explained and identity_error, for each row that
    takes part and each component. A deviation that 64 bits can't hold is null."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(vectors, scale, offset)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    wide, k = model.vectors.shape

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, 1 << 20) if batch.num_rows else ():
                x = np.asarray(part.column("x").flatten(), np.int64).reshape(part.num_rows, wide)
                own = np.repeat(np.arange(len(x)), k)
                deviation = [v if v < 1 << 63 else None for v in map(int, squares(deviations(x, model.n, model.sums)))]
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(pa.array(own)), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": np.full(len(own), model.n),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(own)), "whitened": model.whitened(x).ravel(),
                    "explained": np.tile(model.eigenvalues / model.trace, len(x)), "identity_error": np.full(len(own), model.identity_error),
                })

    return rows.mapInArrow(released(run), schema)
