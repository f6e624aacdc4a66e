"""Correlation of all pairs of columns, over the rows where both have a value.

Pearson: one pass over the table makes, in each task, k x k tables of what every pair of columns has in common: rows with both
values, and sums, squares and products of values less their column's mean, as products of matrices. Tables of tasks add up.

Spearman: ranks are those among the rows that have both values, so that a column has other ranks with each partner. Equal values
are counted by the rows' patterns of nulls, and cumulated in the order of values: a value's ranks with all partners follow from
its counts by pattern. Of each value only the rank in each pattern goes back to its row; a row's ranks with its partners are
sums over patterns, and add to the same tables in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, ramp_up, written
from .ordered import BLOCK
from .results import Reason, results

#: Numbers of a k x k table: rows, the left column's sum and squares, and products.
PARTS = ("n", "s", "q", "p")
#: Pairs that a reason names.
EXAMPLES = 3
#: A value that has one in so many of the rows is frequent: its ranks go to the rows, for all its rows in one task would be too many.
OFTEN = 1 << 12
#: Rows that are worked on at once.
ROWS = 1 << 13


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[numeric(F.col(f"`{c}`"), kinds[c]).alias(c) for c in columns])


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Rows by columns; nulls are NaN."""
    return np.column_stack([np.asarray(batch.column(n).to_numpy(zero_copy_only=False), np.float64) for n in names]) if names else np.zeros((batch.num_rows, 0))


class Moments:
    """What each two of k columns have in common; `add` takes each column's values as its partners see them."""

    def __init__(self, k: int) -> None:
        self.parts = np.zeros((4, k, k))

    def add_rows(self, x: np.ndarray) -> None:
        """Rows of values, the same for all partners; NaN is missing."""
        there = ~np.isnan(x)
        x, there = np.where(there, x, 0.0), there.astype(np.float64)
        self.parts += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])

    def add_pairs(self, x: np.ndarray) -> None:
        """Rows of k x k values: column i's as partner j sees it; 0 where one of both is missing. Counts stay."""
        self.parts[1:] += np.stack([x.sum(axis=0), (x * x).sum(axis=0), (x * x.transpose(0, 2, 1)).sum(axis=0)])

    def batch(self) -> pa.RecordBatch:
        k = self.parts.shape[1]
        at = np.arange(k * k)
        return pa.RecordBatch.from_pydict({"l": at // k, "r": at % k} | dict(zip(PARTS, self.parts.reshape(4, -1), strict=True)))


def co_moments(rows: DataFrame, k: int, add: Callable[[Moments, pa.RecordBatch], None]) -> DataFrame:
    """l, r (columns' numbers) and PARTS: a table for each task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                add(own, batch.slice(at, ROWS))
        yield own.batch()

    found = rows.mapInArrow(run, "l long, r long, " + ", ".join(f"{p} double" for p in PARTS))
    return found.groupBy("l", "r").agg(*[F.sum(p).alias(p) for p in PARTS])


def pearsons(moments: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """left, right and name of each pair of columns and each with itself, left before right: null where one is constant."""
    names = F.array(*map(F.lit, columns))
    other = moments.select(F.col("l").alias("r"), F.col("r").alias("l"), F.col("s").alias("t"), F.col("q").alias("u"))
    both = moments.where("l <= r").join(other, ["l", "r"])
    n = F.when(F.col("n") > 0, F.col("n"))  # else there is no row with both
    over = lambda x, a, b: x / n - a / n * b / n
    spread = lambda q, s: F.when(over(q, s, s) > 1e-14 * q / n, over(q, s, s))  # noqa: E731  below is what rounding leaves of a constant
    value = over(F.col("p"), F.col("s"), F.col("t")) / F.sqrt(spread(F.col("q"), F.col("s"))) / F.sqrt(spread(F.col("u"), F.col("t")))
    within = F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    return both.select(names[F.col("l").cast("int")].alias("left"), names[F.col("r").cast("int")].alias("right"), within.alias(name))


def pearson_table(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """pearsons of a table's numeric columns, in two scans: means, then moments about them."""
    rows = numbers(df, columns)
    means = rows.agg(*[F.coalesce(F.avg(f"`{c}`"), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    centre = np.array([means[f"m{k}"] for k in range(len(columns))])
    names = list(columns)
    return pearsons(co_moments(rows, len(names), lambda own, batch: own.add_rows(_matrix(batch, names) - centre)), columns, name)


def class_ranks(values: DataFrame, codes: dict[str, int] | None, k: int) -> DataFrame:
    """values: series, x, bits (which columns its row has). series, x, often (how often x is there) and ranks: how many values of the series are smaller than
    x, and half of those that are equal, by pattern (codes: their numbers) or, without codes, by column that is there as well.
    Equal values are counted first; different ones are range-partitioned, and a task goes through its own in order."""
    wide = k if codes is None else len(codes)
    counted = values.groupBy("series", "x", "bits").agg(F.count("*").alias("m")).groupBy("series", "x").agg(F.collect_list(F.struct("bits", "m")).alias("m"), F.sum("m").alias("often"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto: dict[int, np.ndarray] = {}

        def out(series: list[int], x: pa.Array, often: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * wide, pa.array(rows.ravel()))
            return pa.RecordBatch.from_pydict({"series": pa.array(series, pa.int64()), "x": x, "often": often, "ranks": lists})

        for batch in batches:
            series, ranks = batch.column("series").to_pylist(), np.zeros((batch.num_rows, wide))
            own = ranks.copy()
            for i, found in enumerate(batch.column("m").to_pylist()):
                for one in found:
                    own[i, slice(None) if codes is None else codes[one["bits"]]] += one["m"] * (np.frombuffer(one["bits"].encode(), np.uint8) - 48.0 if codes is None else 1.0)
            of = np.array(series)
            for s in set(series):
                at = np.flatnonzero(of == s)
                before = upto.get(s, np.zeros(wide))
                sums = np.cumsum(own[at], axis=0)
                ranks[at] = before + sums - own[at] / 2
                upto[s] = before + sums[-1]
            yield out(series, batch.column("x"), batch.column("often"), ranks)
        if upto:  # what the task has of each series, without an x
            yield out(list(upto), pa.nulls(len(upto), pa.float64()), pa.nulls(len(upto), pa.int64()), np.array(list(upto.values())))

    placed = counted.repartitionByRange("series", "x").sortWithinPartitions("series", "x")
    local = placed.mapInArrow(run, "series long, x double, often long, ranks array<double>").withColumn("part", F.spark_partition_id())
    local = written(local, "class-ranks")

    def start(table: pa.Table) -> pa.Table:
        """A series' sums in the parts before each: a row for each range partition that it lies in."""
        table = table.sort_by("part")
        sums = np.array(table.column("ranks").to_pylist()).reshape(-1, wide)
        before = np.cumsum(sums, axis=0) - sums
        return pa.table({"series": table.column("series"), "part": table.column("part"), "start": pa.array(list(before), pa.list_(pa.float64()))})

    starts = local.where("x is null").groupBy("series").applyInArrow(start, "series long, part int, start array<double>")
    ranks = F.zip_with("ranks", "start", lambda a, b: a + b).alias("ranks")
    return local.where("x is not null").join(F.broadcast(starts), ["series", "part"]).select("series", "x", "often", ranks)  # broadcast: a row a range partition and series


def spearman_table(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """left, right and name: Spearman's correlation of each two columns, over the rows where both have a value."""
    k = len(columns)
    rows = numbers(df, columns).toDF(*[f"c{i}" for i in range(k)])
    bits = F.concat(*[F.when(F.col(f"c{i}").isNull(), "0").otherwise("1") for i in range(k)])
    rows = written(rows.select("*", bits.alias("bits")).withColumn("row", F.monotonically_increasing_id()), "rows")
    some = sorted(r["bits"] for r in rows.select("bits").distinct().limit(k + 1).collect())
    codes = {b: p for p, b in enumerate(some)} if len(some) <= k else None  # few patterns: ranks by pattern are shorter
    classes = np.array([[c == "1" for c in b] for b in some], float).reshape(-1, k)
    counts = written(co_moments(rows, k, lambda own, batch: own.add_rows(_matrix(batch, [f"c{i}" for i in range(k)]))).select("l", "r", "n"), "common")
    common = np.zeros((k, k))
    for r in counts.collect():  # k * k numbers
        common[r["l"], r["r"]] = r["n"]
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("series"), F.col(f"c{i}").alias("x")) for i in range(k)]))
    long = rows.select("row", "bits", each.alias("v")).select("row", "bits", "v.*").where("x is not null")
    ranks, n = class_ranks(long, codes, k), rows.count()
    frequent = F.col("often") * OFTEN >= n
    mine = long.join(F.broadcast(ranks.where(frequent)), ["series", "x"], "left")  # broadcast: OFTEN rows a column at most
    rare = mine.where("ranks is null").drop("ranks", "often").join(ranks.where(~frequent), ["series", "x"])
    ranked = mine.where("ranks is not null").unionByName(rare).select("row", "series", "ranks")
    ranked = ranked.groupBy("row").agg(*[F.first(F.when(F.col("series") == i, F.col("ranks")), ignorenulls=True).alias(f"r{i}") for i in range(k)])
    whole = len(some) == 1 and "0" not in some[0]

    def add(own: Moments, batch: pa.RecordBatch) -> None:
        found = [batch.column(f"r{i}") for i in range(k)]
        there = np.column_stack([np.asarray(c.is_valid()) for c in found])
        held = [np.asarray(c.flatten()).reshape(int(n), k if codes is None else len(codes)) for c, n in zip(found, there.sum(axis=0), strict=True)]
        if whole:  # a column's ranks are the same with all partners
            own.add_rows(np.concatenate(held, axis=1) - common.diagonal() / 2)
            return
        step = max(1, (1 << 20) // (k * k))
        place = np.cumsum(there, axis=0) - there
        for a in range(0, len(there), step):
            some = there[a : a + step]
            x = np.zeros((len(some), k, k))
            for i in range(k):
                own_ranks = held[i][place[a, i] : place[a, i] + int(some[:, i].sum())]
                by_partner = own_ranks if codes is None else (own_ranks * classes[:, i]) @ classes
                x[some[:, i], i] = by_partner - common[i] / 2  # about the middle rank
            own.add_pairs(x * some[:, None, :])

    return pearsons(co_moments(ranked, k, add).drop("n").join(counts, ["l", "r"]), columns, name)


def heatmap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """left, right and value: Pearson correlations of each column with each, itself included; 0 where one is constant."""
    found = pearson_table(df, columns, "value").withColumn("value", F.coalesce("value", F.lit(0.0)))
    mirrored = found.where("left <> right").select(F.col("right").alias("left"), F.col("left").alias("right"), "value")
    return found.unionAll(mirrored)


def pair_table(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """left, right, pearson and spearman of all pairs of numeric columns; null where one is constant."""
    different = F.col("left") != F.col("right")
    return pearson_table(df, columns, "pearson").where(different).join(spearman_table(df, columns, "spearman").where(different), ["left", "right"])


def correlation(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    spark = df.sparkSession
    if len(columns) < 2:
        one = spark.range(1).select(F.lit("(table)").alias("series"), F.lit(len(columns)).alias("n"))
        return results(one, "correlation", {}, {}, [], least=2, short=(70.0, "limited"))
    pairs = written(pair_table(df, columns, block).where("pearson is not null and spearman is not null"), "pairs")
    most = F.greatest(F.abs("pearson"), F.abs("spearman"))
    names = F.array(*map(F.lit, columns))
    order = [F.array_position(names, F.col("left")), F.array_position(names, F.col("right"))]
    example = F.format_string("%s-%s: Pearson=%.3f, Spearman=%.3f", "left", "right", "pearson", "spearman").alias("told")
    first = lambda least: "; ".join(r["told"] for r in pairs.where(most > least).orderBy(*order).limit(EXAMPLES).select(example).collect())
    sums = pairs.agg(
        F.count("*").alias("pairs"), F.coalesce(F.avg(F.abs("pearson")), F.lit(0.0)).alias("mean"), F.coalesce(F.max(most), F.lit(0.0)).alias("most"),
        F.sum((most > 0.99).cast("int")).alias("n_high"), F.sum((most > 0.999).cast("int")).alias("n_very"),
    ).withColumns({"series": F.lit("(table)"), "n": F.lit(len(columns))})
    return results(
        sums, "correlation",
        {"pair_count": F.col("pairs"), "average_abs_pearson": F.col("mean"), "max_abs_correlation": F.col("most"), "high_pair_count": F.coalesce("n_high", F.lit(0)), "very_high_pair_count": F.coalesce("n_very", F.lit(0))},
        {
            "perfect_correlation_penalty": ramp_up(F.col("max_abs_correlation"), 0.999, 1, 35),
            "high_correlation_penalty": ramp_up(F.least(F.col("max_abs_correlation"), F.lit(0.999)), 0.99, 0.999, 14),
            "average_correlation_penalty": F.when(F.col("pair_count") >= 3, ramp_up(F.col("average_abs_pearson"), 0.96, 1, 18)).otherwise(0.0),
        },
        [
            Reason(f"Columns are almost perfectly correlated, as if derived or copied: {first(0.999)}", F.col("very_high_pair_count") > 0),
            Reason(f"Columns are correlated so strongly that it needs an explanation: {first(0.99)}", (F.col("very_high_pair_count") == 0) & (F.col("high_pair_count") > 0)),
            Reason("Columns move together too closely on the whole.", F.col("average_correlation_penalty") > 0),
        ],
    )
