"""Local outlier factors of all rows of a table over their nearest neighbours among all rows, repeated rows counted.

Different rows are dealt to the leaves of a k-d tree, some thousand to a leaf. A row looks for its neighbours in its own leaf first;
where another leaf's box is no further than the k-th of them, the row asks there, and that leaf lends its home the rows that lie as
near. So a leaf with what it was lent knows its rows' neighbours exactly. Densities need the neighbours' reach, and factors their
densities: these are handed to the leaves in the same way. Of rows at the same distance, the first by value are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .forest import squared_distances

#: Different rows of a leaf, about, and the rows that tell where to cut for each leaf; rows of a block within a leaf.
LEAF, SHOWN, SMALL = 1 << 14, 32, 160


@dataclass(frozen=True)
class Tree:
    """Nodes: the column and the value they cut at, and two children; leaves have a number instead."""

    columns: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    def of(self, y: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(y), np.intp), np.arange(len(y))
        while (inner := self.leaf[node] < 0).any():
            node = np.where(inner, self.children[node, (y[every, self.columns[node]] > self.cuts[node]).astype(int)], node)
        return self.leaf[node]


def grow_tree(x: np.ndarray, leaves: int) -> Tree:
    """Cuts of the widest column, into leaves of about as many rows."""
    columns, cuts, children, leaf = [0], [np.inf], [[0, 0]], [-1]
    todo, made = [(0, x, leaves)], 0
    while todo:
        node, part, wanted = todo.pop()
        widths = np.ptp(part, 0) if len(part) else np.zeros(1)
        if wanted < 2 or not widths.max() > 0:
            leaf[node], made = made, made + 1
            continue
        j = int(widths.argmax())
        values = np.sort(part[:, j])
        cut = values[max(0, len(values) * (wanted // 2) // wanted - 1)]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        columns[node], cuts[node], children[node] = j, cut, [len(leaf), len(leaf) + 1]
        left = part[:, j] <= cut
        todo += [(len(leaf), part[left], wanted // 2), (len(leaf) + 1, part[~left], wanted - wanted // 2)]
        columns += [0, 0]
        cuts += [np.inf, np.inf]
        children += [[0, 0], [0, 0]]
        leaf += [-1, -1]
    return Tree(np.array(columns), np.array(cuts), np.array(children), np.array(leaf))


def blocks(x: np.ndarray, size: int = SMALL) -> list[np.ndarray]:
    """Places of rows that lie close together, up to size of them in each."""
    todo, out = [np.arange(len(x))] if len(x) else [], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(np.sort(part))
            continue
        j = int(np.ptp(x[part], 0).argmax())
        part = part[np.argsort(x[part, j], kind="stable")]
        values, half = x[part, j], len(part) // 2
        lo, hi = np.searchsorted(values, values[half]), np.searchsorted(values, values[half], side="right")
        if 0 < lo and (half - lo <= hi - half or hi == len(part)):  # equal values stay together
            half = lo
        elif hi < len(part):
            half = hi
        todo += [part[:half], part[half:]]
    return out


def ends(x: np.ndarray, parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    shape = (len(parts), x.shape[1])
    return np.array([x[p].min(0) for p in parts]).reshape(shape), np.array([x[p].max(0) for p in parts]).reshape(shape)


def apart(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (or points) to boxes: as they are rounded, none is above that of two points within."""
    out = np.zeros((len(lo), len(los)))
    for j in range(lo.shape[1]):
        out += np.maximum(np.maximum(los[None, :, j] - hi[:, j, None], lo[:, j, None] - his[None, :, j]), 0) ** 2
    return out


def nearest_copies(x: np.ndarray, copies: np.ndarray, asking: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asking row (a place in x): the places of its k nearest other rows, nearest first and then in x's order, a row as
    often as it has copies, and their squared distances. Places of rows with fewer others are -1 at the end, their distances inf."""
    parts = blocks(x)
    los, his = ends(x, parts)
    places = np.full(len(x), -1)
    places[asking] = np.arange(len(asking))
    sizes = np.array([len(p) for p in parts])
    near, dist = np.full((len(asking), k), -1), np.full((len(asking), k), np.inf)
    for part in parts:
        own = part[places[part] >= 0]
        if not len(own):
            continue
        y = x[own]
        far = apart(y.min(0)[None], y.max(0)[None], los, his)[0]
        order = np.argsort(far, kind="stable")
        enough = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1
        some = np.concatenate([parts[b] for b in order[:enough]])
        last = np.partition(squared_distances(y, x[some]), k, 1)[:, k] if len(some) > k else np.full(len(y), np.inf)  # itself and k others
        some = np.sort(np.concatenate([parts[b] for b in np.flatnonzero(far <= last.max())]))
        i, j = within(y, x[some], last)
        j = some[j]
        d = sum(((y[i, c] - x[j, c]) ** 2 for c in range(1, x.shape[1])), (y[i, 0] - x[j, 0]) ** 2)
        first = np.searchsorted(i, np.arange(len(own) + 1))
        widths = np.diff(first)
        at = np.arange(widths.max()) < widths[:, None]
        others, squares = np.full(at.shape, -1), np.full(at.shape, np.inf)
        others[at], squares[at] = j, d
        order = np.argsort(squares, 1, kind="stable")
        others, squares = np.take_along_axis(others, order, 1), np.take_along_axis(squares, order, 1)
        times = np.where(others >= 0, copies[others] - (others == own[:, None]), 0)
        taken = np.clip(k - (np.cumsum(times, 1) - times), 0, times)
        filled = np.arange(k) < taken.sum(1)[:, None]
        found, square = near[places[own]], dist[places[own]]
        found[filled], square[filled] = np.repeat(others.ravel(), taken.ravel()), np.repeat(squares.ravel(), taken.ravel())
        near[places[own]], dist[places[own]] = found, square
    return near, dist


def within(y: np.ndarray, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of y, and of x in order, that are no further apart than y's squares tell, and of few others: what numbers of
    32 bits leave in doubt is within."""
    a, b = y - y[0], x - y[0]
    top = max(np.abs(a).max(), np.abs(b).max())
    if not 0 < top < 1e150:
        return np.nonzero(np.ones((len(y), len(x)), bool))
    size = 2.0 ** -np.ceil(np.log2(top))  # no number is too large for 32 bits then
    a, b, squares = a * size, b * size, squares * size * size
    own, length = (a * a).sum(1), (b * b).sum(1)
    sure = 1 - (x.shape[1] + 4) * 2.0**-21
    rough = np.column_stack([-2 * a, np.ones(len(a))]).astype(np.float32) @ np.column_stack([b, sure * length]).astype(np.float32).T
    return np.nonzero(rough <= np.minimum(squares - own + (1 - sure) * (own + squares) + 1e-30, 1e9)[:, None].astype(np.float32))


def in_order(part: pd.DataFrame, columns: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in the order of their values, and the values."""
    x = part[list(columns)].to_numpy(float)
    order = np.lexsort(x.T) if len(x) else np.arange(0)
    return part.iloc[order], x[order]


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes: those of many rows are had at once, as those of an array of each aren't."""
    whole, size = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return [whole[at : at + size] for at in range(0, len(whole), size)]


def unpacked(rows: pd.Series, kind: type, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(-1, k)


def tree_of(counted: DataFrame, columns: Sequence[str], n: int) -> Tree:
    """For n different rows; some of them show where to cut, which no result rests on."""
    leaves = -(-n // LEAF)
    share = min(1.0, SHOWN * leaves / n) if leaves > 1 else 0.0
    spread = F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(1 << 52)) / float(1 << 52)
    shown = counted.where(spread < share).select(*columns).toPandas().to_numpy(float).reshape(-1, len(columns))
    return grow_tree(shown[np.lexsort(shown.T)], leaves)


def dealt(counted: DataFrame, columns: Sequence[str], tree: Tree) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """counted with leaf and id, and the leaves' boxes."""
    shared, k = counted.sparkSession.sparkContext.broadcast(tree), len(columns)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(leaf=shared.value.of(part[list(columns)].to_numpy(float)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
    rows = written(counted.mapInPandas(deal, schema + ", leaf long").withColumn("id", F.monotonically_increasing_id()), "neighbour-rows")
    found = rows.groupBy("leaf").agg(*[f(c).alias(f"{c}{e}") for e, f in (("<", F.min), (">", F.max)) for c in columns]).collect()  # a row a leaf
    return rows, {r["leaf"]: (np.array(r[1 : k + 1], float), np.array(r[k + 1 :], float)) for r in found}


def factors(counted: DataFrame, columns: Sequence[str], k: int, tree: Tree, keep: Sequence[str] = ()) -> DataFrame:
    """factor: the outlier factors over k neighbours of different rows, each of which is there n times (column n), with the columns
    to keep. Rows in all are more than k."""
    columns, keep = list(columns), list(keep)
    values = ", ".join(f"{c} double" for c in columns)
    rows, boxes = dealt(counted, columns, tree)
    spark = counted.sparkSession
    names = np.array(sorted(boxes))
    shared = spark.sparkContext.broadcast((names, np.array([boxes[b][0] for b in names]), np.array([boxes[b][1] for b in names])))
    members = rows.select("leaf", "id", *columns, "n")

    def ask(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        (home,), (leaves, los, his) = key, shared.value
        part, x = in_order(part, columns)
        copies = part["n"].to_numpy()
        asking = np.flatnonzero(copies <= k)  # others are their own neighbours
        reach = nearest_copies(x, copies, asking, k)[1][:, -1]
        i, to = [], []
        for block in blocks(x[asking]):
            y = x[asking[block]]
            there = np.flatnonzero((apart(y.min(0)[None], y.max(0)[None], los, his)[0] <= reach[block].max()) & (leaves != home))
            a, b = np.nonzero(apart(y, y, los[there], his[there]) <= reach[block][:, None])
            i.append(block[a])
            to.append(there[b])
        i, to = (np.concatenate(v) if v else np.zeros(0, int) for v in (i, to))
        return pd.DataFrame(x[asking[i]], columns=columns).assign(leaf=leaves[to], home=home, reach=reach[i])[["leaf", "home", *columns, "reach"]]

    asked = members.groupBy("leaf").applyInPandas(ask, f"leaf long, home long, {values}, reach double")

    def lend(part: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        x = part[columns].to_numpy(float)
        parts = blocks(x)
        los, his = ends(x, parts)
        out = []
        for home, own in asks.groupby("home"):
            y, reach, wanted = own[columns].to_numpy(float), own["reach"].to_numpy(), np.zeros(len(x), bool)
            for block in blocks(y):
                z, r = y[block], reach[block]
                there = np.flatnonzero(apart(z.min(0)[None], z.max(0)[None], los, his)[0] <= r.max())
                if len(there) and len(some := (some := np.concatenate([parts[b] for b in there]))[~wanted[some]]):
                    wanted[some[(squared_distances(z, x[some]) <= r[:, None]).any(0)]] = True
            out.append(part[wanted].assign(leaf=home))
        return pd.concat(out)[["leaf", "id", *columns, "n"]] if out else part.iloc[:0][["leaf", "id", *columns, "n"]]

    lent = written(members.groupBy("leaf").cogroup(asked.groupBy("leaf")).applyInPandas(lend, f"leaf long, id long, {values}, n long"), "neighbours-lent")
    kept = "".join(f", `{c}` {counted.schema[c].dataType.simpleString()}" for c in keep)

    def find(part: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        every, x = in_order(pd.concat([part.assign(own=np.arange(len(part))), others.assign(own=-1)])[["id", *columns, "n", "own"]], columns)
        ids, copies, place = (every[c].to_numpy() for c in ("id", "n", "own"))
        own = np.flatnonzero(place >= 0)
        asking = own[copies[own] <= k]
        near, squares = np.repeat(own[:, None], k, 1), np.zeros((len(own), k))
        near[copies[own] <= k], squares[copies[own] <= k] = nearest_copies(x, copies, asking, k)
        rank = np.argsort(np.argsort(ids))[near].astype(np.int32)  # places among the ids that the leaf knows
        distance = np.sqrt(squares)
        return part.iloc[place[own]][["leaf", "id", *keep]].assign(reach=distance[:, -1], near=packed(rank), distance=packed(distance))

    lists = rows.groupBy("leaf").cogroup(lent.groupBy("leaf")).applyInPandas(find, f"leaf long, id long{kept}, reach double, near binary, distance binary")
    lists = written(lists, "neighbour-lists")

    def known(part: pd.DataFrame, others: pd.DataFrame, name: str) -> np.ndarray:
        """The neighbours' values."""
        ids, values = np.concatenate([part["id"], others["id"]]), np.concatenate([part[name], others["known"]])
        return values[np.argsort(ids)][unpacked(part["near"], np.int32, k)]

    def density(part: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        reach = np.maximum(known(part, others, "reach"), unpacked(part["distance"], float, k)).mean(1)
        return part.assign(density=1 / (reach + 1e-10))[["leaf", "id", *keep, "near", "density"]]

    def factor(part: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return part.assign(factor=known(part, others, "density").mean(1) / part["density"])[[*keep, "factor"]]

    def with_lent(df: DataFrame, name: str):
        return df.groupBy("leaf").cogroup(lent.select("leaf", "id").join(df.select("id", F.col(name).alias("known")), "id").groupBy("leaf"))

    dense = written(with_lent(lists, "reach").applyInPandas(density, f"leaf long, id long{kept}, near binary, density double"), "neighbour-densities")
    return with_lent(dense, "density").applyInPandas(factor, f"{kept[2:] + ', ' if keep else ''}factor double")
