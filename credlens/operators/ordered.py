"""Ordered series: every numeric column in the order of the table, without its missing values.

The table is range-partitioned by its order once, all columns together, and each task cuts its columns' values into pieces of a
few thousand, which are written (`Ordered.pieces`). A piece knows the place of its first value, and the HALO values before and
after it: a table with a row a partition and series tells what partitions begin and end with. Indicators work piece by piece, and
give a row of sums each (`each_piece`); running sums and minima add what earlier pieces come to. So the values move once, and no
task holds a whole series. What needs no order reads `Ordered.values`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric, written

BLOCK = 1 << 20
#: Values that a piece knows on both sides (indicators reach no further), and those of a piece.
HALO, PIECE = 20, 1 << 12
STATS = "series string, n long, mean double, sd double, lo double, hi double"


@dataclass(frozen=True)
class Stats:
    """Of a series' values; sd is the population's."""

    n: int
    mean: float
    sd: float
    lo: float
    hi: float


@dataclass(frozen=True)
class Piece:
    """Values of a series from place `at` on, up to HALO values before and after, and what `each_piece` was asked for."""

    series: str
    at: int
    x: np.ndarray
    before: np.ndarray
    after: np.ndarray
    of: Stats
    known: dict[str, float]

    @property
    def since(self) -> np.ndarray:
        return np.concatenate([self.before, self.x])


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    columns: Sequence[str]
    order: Sequence[str]
    stats: dict[str, Stats]
    block: int = BLOCK

    @property
    def counts(self) -> dict[str, int]:
        return {k: s.n for k, s in self.stats.items()}

    @property
    def blocks(self) -> int:
        return -(-max(self.counts.values(), default=0) // self.block)

    @cached_property
    def pieces(self) -> DataFrame:
        """series, at, x, before, after (doubles, packed) and s, the sum of x less the series' mean."""
        return cut(self)

    @cached_property
    def values(self) -> DataFrame:
        """series, x and STATS, in no order: of the pieces, if they were made, for they are cheaper to read."""
        found = self._unpacked() if "pieces" in self.__dict__ else long_form(self.df, self.columns)
        return self._with_stats(found.select("series", "x"))

    @cached_property
    def rows(self) -> DataFrame:
        """series, i (from 0), x, and the series' STATS."""
        return self._with_stats(self._unpacked())

    def _unpacked(self) -> DataFrame:
        return each_piece(self, "series string, i long, x double", lambda p: {"series": pa.repeat(p.series, len(p.x)), "i": p.at + np.arange(len(p.x)), "x": p.x})

    def _with_stats(self, rows: DataFrame) -> DataFrame:
        found = [(k, s.n, s.mean, s.sd, s.lo, s.hi) for k, s in self.stats.items()]
        return rows.join(F.broadcast(self.df.sparkSession.createDataFrame(found, STATS)), "series")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """series and x, a row for each value that isn't missing."""
    kinds = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), numeric(F.col(f"`{c}`"), kinds[c]).alias("x")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.series", "p.x").where("x is not null")


def ordered(df: DataFrame, columns: Sequence[str], order: Sequence[str], block: int = BLOCK) -> Ordered:
    """The columns' series in the order given (missing order values last). order must be total for repeatable results."""
    kinds = dict(df.dtypes)
    wide = df.select(*[numeric(F.col(f"`{c}`"), kinds[c]).alias(f"c{k}") for k, c in enumerate(columns)])
    of = {"n": F.count, "mean": F.avg, "sd": F.stddev_pop, "lo": F.min, "hi": F.max}
    found = wide.agg(F.lit(0).alias("_"), *[f(f"c{k}").alias(f"{s}{k}") for k in range(len(columns)) for s, f in of.items()]).first()
    return Ordered(df, columns, order, {c: Stats(*[found[f"{s}{k}"] for s in of]) for k, c in enumerate(columns) if found[f"n{k}"]}, block)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def unpacked(x) -> np.ndarray:
    return np.frombuffer(x) if len(x) else np.empty(0)


class Cutter:
    """Cuts a column's values in a task into pieces; `end` gives the rest, and what the task's values begin and end with."""

    SCHEMA = "series string, part int, chunk long, first long, x binary, before binary, after binary, s double"
    ARROW = pa.schema([("series", pa.string()), ("part", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("x", pa.binary()), ("before", pa.binary()), ("after", pa.binary()), ("s", pa.float64())])

    def __init__(self, series: str, mean: float, part: int, size: int) -> None:
        self.series, self.mean, self.part, self.size = series, mean, part, size
        self.n = self.chunk = 0
        self.head = self.tail = self.held = np.empty(0)

    def row(self, x: np.ndarray, after: bytes | None) -> pa.RecordBatch:
        before = packed(self.tail) if self.chunk else None  # null: what the partitions before end with
        out = (self.series, self.part, self.chunk, self.n, packed(x), before, after, float((x - self.mean).sum()))
        self.tail = np.concatenate([self.tail, x])[-HALO:]
        self.n, self.chunk = self.n + len(x), self.chunk + 1
        return self.batch(out)

    def batch(self, row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, self.ARROW, strict=True)], schema=self.ARROW)

    def add(self, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.head = np.concatenate([self.head, x[: HALO - len(self.head)]])
        held, at = np.concatenate([self.held, x]), 0
        while len(held) - at >= self.size + HALO:
            end = at + self.size
            yield self.row(held[at:end], packed(held[end : end + HALO]))
            at = end
        self.held = held[at:].copy()

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.held):
            yield self.row(self.held, None)
        if self.n:
            yield self.batch((self.series, self.part, None, self.n, None, packed(self.head), packed(self.tail), None))


def neighbours(table: pd.DataFrame) -> pd.DataFrame:
    """A row a partition of one series: the place of its first value, and the HALO values before and after it."""
    table = table.sort_values("part")
    prev, next_, last = [], [], np.empty(0)
    for end in table["after"]:
        prev.append(packed(last))
        last = np.concatenate([last, unpacked(end)])[-HALO:]
    last = np.empty(0)
    for head in table["before"][::-1]:
        next_.append(packed(last))
        last = np.concatenate([unpacked(head), last])[:HALO]
    n = table["first"].to_numpy()
    return pd.DataFrame({"series": table["series"], "part": table["part"], "offset": np.cumsum(n) - n, "prev": prev, "next": next_[::-1]})


def cut(series: Ordered) -> DataFrame:
    df, kinds = series.df, dict(series.df.dtypes)
    means, size = [(c, s.mean) for c, s in series.stats.items()], max(HALO, min(series.block, PIECE))
    keys = [F.col(f"o{k}").asc_nulls_last() for k in range(len(series.order))]
    wide = df.select(*[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(series.order)], *[numeric(F.col(f"`{c}`"), kinds[c]).alias(f"c{k}") for k, (c, _) in enumerate(means)])
    placed = wide.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[f"c{k}" for k in range(len(means))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = [Cutter(c, mean, part, size) for c, mean in means]
        for batch in batches:
            for one, column in zip(own, batch.columns, strict=True):
                yield from one.add(column.drop_null().to_numpy())
        for one in own:
            yield from one.end()

    # small row groups: a reader holds few pieces at once
    table = written(placed.mapInArrow(run, Cutter.SCHEMA), "pieces", compression="zstd", **{"parquet.block.size": 16 << 20})
    ends = table.where("chunk is null").select("series", "part", "first", "before", "after")
    starts = written(ends.groupBy("series").applyInPandas(neighbours, "series string, part int, offset long, prev binary, next binary"), "starts")
    found = table.where("chunk is not null").join(F.broadcast(starts), ["series", "part"])  # broadcast: a row a partition and series
    return found.select("series", (F.col("offset") + F.col("first")).alias("at"), "x", F.coalesce("before", "prev").alias("before"), F.coalesce("after", "next").alias("after"), "s")


def each_piece(series: Ordered, schema: str, run: Callable[[Piece], dict], known: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """What run gives for each piece: a row of numbers, or rows of arrays. known: numbers for each series and at.
    in_order: a task goes through all of a series in order."""
    pieces, more, stats = series.pieces.drop("s"), [], series.stats
    if known is not None:
        more = [c for c in known.columns if c not in ("series", "at")]
        few = sum(series.counts.values()) <= PIECE << 20
        pieces = pieces.join(F.broadcast(known) if few else known, ["series", "at"])
    if in_order:
        pieces = pieces.repartition("series").sortWithinPartitions("series", "at")
    names = [f.split()[0] for f in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = lambda v: unpacked(v.as_buffer())
        for batch in batches:
            at, of = batch.column("at").to_pylist(), batch.column("series").to_pylist()
            x, before, after = (batch.column(c) for c in ("x", "before", "after"))
            known = [batch.column(c).to_pylist() for c in more]
            rows = []
            with np.errstate(all="ignore"):
                for k, name in enumerate(of):
                    found = run(Piece(name, at[k], view(x[k]), view(before[k]), view(after[k]), stats[name], {c: v[k] for c, v in zip(more, known, strict=True)}))
                    if any(isinstance(v, np.ndarray) for v in found.values()):
                        yield pa.RecordBatch.from_pydict({c: found[c] for c in names})
                    else:
                        rows.append({"series": name, "at": at[k]} | {c: v if v is None or isinstance(v, int) else v.item() if isinstance(v, np.generic) else v for c, v in found.items()})
            if rows:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], schema=pa.schema([(c, ARROW[t]) for c, t in (f.split() for f in schema.split(", "))]))

    return pieces.mapInArrow(go, schema)


ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def moments(name: str, v: np.ndarray) -> dict[str, float]:
    """Count, mean and sum of squares about it, as `spread` puts them together."""
    mean = float(v.mean()) if len(v) else 0.0
    return {f"n_{name}": len(v), f"m_{name}": mean, f"q_{name}": float(((v - mean) ** 2).sum())}


def moment_columns(*names: str) -> str:
    return ", ".join(f"n_{c} long, m_{c} double, q_{c} double" for c in names)


def with_means(parts: DataFrame, *names: str) -> DataFrame:
    """Rows of moments with the mean of all (a_name)."""
    whole = Window.partitionBy("series")
    return parts.withColumns({f"a_{c}": F.try_divide(F.sum(F.col(f"n_{c}") * F.col(f"m_{c}")).over(whole), F.sum(f"n_{c}").over(whole)) for c in names})


def spread(name: str, least: int = 1) -> Column:
    """Standard deviation of what `with_means` has a row each of: of a sample, or with least 0 of a population."""
    n, away = F.sum(f"n_{name}"), F.col(f"m_{name}") - F.col(f"a_{name}")
    return F.when(n > least, F.sqrt(F.sum(F.col(f"q_{name}") + F.col(f"n_{name}") * away * away) / (n - least)))


def earlier(value: Column, fold: Callable = F.sum) -> Column:
    """What earlier pieces of a series come to."""
    return fold(value).over(Window.partitionBy("series").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))


def cumulated(values: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, x, m (how often x is in its group), start (values of the group before the first x) and total (values of the
    group). Equal values are counted first, so that ties of any number are one row; different ones are range-partitioned."""
    counted = values.groupBy(*groups, "x").agg(F.count("*").alias("m"))
    placed = counted.repartitionByRange(*map(F.col, groups), F.col("x").asc()).withColumn("part", F.spark_partition_id())
    placed = written(placed, "counted")
    parts = placed.groupBy(*groups, "part").agg(F.sum("m").alias("in_part"))
    upto = F.sum("in_part").over(Window.partitionBy(*groups).orderBy("part"))
    parts = parts.withColumns({"offset": upto - F.col("in_part"), "total": F.sum("in_part").over(Window.partitionBy(*groups))}).drop("in_part")
    local = F.sum("m").over(Window.partitionBy(*groups, "part").orderBy("x")) - F.col("m")
    found = placed.withColumn("local", local).join(parts, [*groups, "part"])
    return found.select(*groups, "x", "m", (F.col("offset") + F.col("local")).alias("start"), "total")


#: Share of the values that a sketch's quantiles may be off by.
OFF = 1e-4


def ranked(values: DataFrame, name: str, shares: Sequence[float], margin: float = 2 * OFF) -> dict[str, list[tuple[float, int, int]]]:
    """By series and share: the exact quantile by linear interpolation, how many values are smaller, and how many there are.

    A sketch gives two values for each share that its ranks must lie between; values outside are counted, and only those between
    are counted each and cumulated. Ranks that lie outside all the same are looked for with a wider margin."""
    values = values.select("series", F.col(name).alias("x")).where("x is not null")
    ends = [e for s in shares for e in (max(0.0, s - margin), min(1.0, s + margin))]
    sketch = values.groupBy("series").agg(F.percentile_approx("x", ends, int(1 / OFF)).alias("e"), F.count("*").alias("total")).collect()  # a row a series
    if not sketch:
        return {}
    totals = {r["series"]: r["total"] for r in sketch}
    bounds = [(r["series"], *[v if 0 < e < 1 else None for v, e in zip(r["e"], ends, strict=True)]) for r in sketch]  # null: no bound
    near = values.sparkSession.createDataFrame(bounds, ", ".join(["series string", *[f"{e}{k} double" for k in range(len(shares)) for e in "ab"]]))
    joined, x = values.join(F.broadcast(near), "series"), F.col("x")
    below = [F.sum(F.when(x < F.col(f"a{k}"), 1).otherwise(0)).alias(f"below{k}") for k in range(len(shares))]
    smaller = {r["series"]: r for r in joined.groupBy("series").agg(*below).collect()}  # a row a series
    within = [~F.coalesce(x < F.col(f"a{k}"), F.lit(False)) & ~F.coalesce(x > F.col(f"b{k}"), F.lit(False)) for k in range(len(shares))]
    of = F.explode(F.array(*[F.when(w, k) for k, w in enumerate(within)])).alias("k")
    counted = joined.where(reduce(or_, within)).select("series", "x", of).where("k is not null").groupBy("series", "k", "x").agg(F.count("*").alias("m"))
    wanted = [(s, k, smaller[s][f"below{k}"], int(np.floor((t - 1) * share)), int(np.ceil((t - 1) * share))) for s, t in totals.items() for k, share in enumerate(shares)]
    wanted = values.sparkSession.createDataFrame(wanted, "series string, k int, below long, r0 long, r1 long")
    upto = F.col("below") + F.sum("m").over(Window.partitionBy("series", "k").orderBy("x"))
    places = counted.join(F.broadcast(wanted), ["series", "k"]).withColumn("upto", upto)
    holds = lambda r: (F.col("upto") - F.col("m") <= F.col(r)) & (F.col(r) < F.col("upto"))
    found = places.groupBy("series", "k").agg(*[F.max(F.when(holds(r), F.struct("x", (F.col("upto") - F.col("m")).alias("start"), "upto"))).alias(r) for r in ("r0", "r1")]).collect()  # a row a series and share
    got = {(r["series"], r["k"]): r for r in found if r["r0"] and r["r1"]}
    if len(got) < len(totals) * len(shares):
        return ranked(values.select("series", F.col("x").alias(name)), name, shares, 100 * margin)
    out: dict[str, list[tuple[float, int, int]]] = {s: [] for s in totals}
    for s, t in totals.items():
        for k, share in enumerate(shares):
            at, r = (t - 1) * float(share), got[s, k]
            low, high = r["r0"]["x"], r["r1"]["x"]
            q = low + (high - low) * (at - np.floor(at))
            out[s].append((float(q), r["r0"]["upto"] if q > low else r["r0"]["start"], t))
    return out


def quantiles(values: DataFrame, name: str, shares: Sequence[float], counts: dict[str, int], block: int = BLOCK) -> DataFrame:
    """series and q0, q1, ...: exact quantiles by linear interpolation of the column name, nulls left out."""
    if max(counts.values(), default=0) <= block:
        found = values.select("series", F.col(name).alias("x")).where("x is not null").groupBy("series").agg(F.percentile("x", F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
        return found.select("series", *[F.col("q")[k].alias(f"q{k}") for k in range(len(shares))])
    found = [(s, *[r[0] for r in rs]) for s, rs in ranked(values, name, shares).items()]
    return values.sparkSession.createDataFrame(found, ", ".join(["series string", *[f"q{k} double" for k in range(len(shares))]]))
