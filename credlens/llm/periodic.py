"""Periodic runs of words: repeated k-grams mask the texts, Main-Lorentz finds the runs in what is left.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q, of at least max(shortest,
times * q) words. Shifted by q, it overlaps itself in `overlap(shortest, times)` = k words at least, so that each of its words
stands in a k-gram that its document holds twice. Words outside of such k-grams can't join a run; stretches of the others are
worked on: each is halved again and again, and a run that crosses a middle is found by how far equal words reach to both
sides of it, for all periods of all blocks of a level at once. What is compared are two polynomial hashes modulo primes; each
run is then held against its words, and all is done anew with other hashes if one fails (chances are about 2^-60).

A text is one task's work, memory about 150 bytes a word. Null and empty texts have no words and no runs. Rows are independent:
repeated ids are separate rows, a null id stays null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrays import MULTIPLIER, mixed
from .common import map_batches, texts_of

#: Words of a run, and times its period, at least.
SHORTEST, TIMES = 24, 3
#: Pairs of a block and a period that are looked at together.
PAIRS = 1 << 18
PRIMES = (2147483647, 2147483629)

#: Which original word stands at each place of a document: None, or an array of places, from its id and number of words.
Order = Callable[[int | None, int], np.ndarray | None]


def overlap(shortest: int, times: int) -> int:
    """Words that the shortest run of any period shares with itself shifted by that period, at least."""
    return min(max(shortest, times * q) - q for q in range(1, shortest + 1))


def repeated(ids: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Whether each word stands in a k-gram that its document holds at least twice. offsets: where documents begin and end."""
    n = len(ids)
    if n < k:
        return np.zeros(n, bool)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams, width, out = mixed(ids.astype(np.uint64) + np.uint64(1)), 1, None
    for bit in bin(k)[:1:-1]:  # a k-gram is made of pieces of the lengths that k's bits name
        if bit == "1":
            rest = grams if out is None else out[1]
            out = (width, grams) if out is None else (out[0] + width, mixed(rest[: n - out[0] - width + 1] * MULTIPLIER + grams[out[0] : n - width + 1]))
        grams = mixed(grams[: max(0, len(grams) - width)] * MULTIPLIER + grams[width:])
        width *= 2
    whole = np.flatnonzero(document[: n - k + 1] == document[k - 1 :])  # k-grams within one document
    if not len(whole):
        return np.zeros(n, bool)
    keys = mixed(out[1][whole] * MULTIPLIER + document[whole].astype(np.uint64))
    by = np.argsort(keys, kind="stable")
    equal = keys[by][1:] == keys[by][:-1]
    again = whole[by[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]]
    edges = np.zeros(n + 1, np.int32)
    edges[again] += 1
    edges[again + k] -= 1
    return np.cumsum(edges[:-1]) > 0


class Extensions:
    """How far words from two places on, or before them, are equal."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        self.sums, self.powers = [], []
        for prime in PRIMES:
            base = int(mixed(np.array([seed * 2 + 12345], np.uint64))[0] % np.uint64(prime - 1000)) + 500
            powers, k = np.ones(len(ids) + 1, np.uint64), 1
            while k < len(powers):
                more = min(k, len(powers) - k)
                powers[k : k + more] = powers[:more] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
                k *= 2
            values = mixed(ids.astype(np.uint64) + np.uint64((seed + 7) << 40)) % np.uint64(prime)
            sums = np.cumsum(values * powers[:-1] % np.uint64(prime)) % np.uint64(prime)
            self.sums.append(np.concatenate([[0], sums]).astype(np.uint32))
            self.powers.append(powers.astype(np.uint32))

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and from j (i <= j) are equal."""
        out = np.ones(len(i), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            piece = lambda at, prime=prime, sums=sums: (sums[at + n].astype(np.int64) - sums[at]) % prime
            out &= piece(i) * powers[j - i].astype(np.int64) % prime == piece(j)
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i and j on (or before them, if back) are equal, up to most."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_] + 1) // 2
            shift = mid if back else 0
            good = self.same(i[open_] - shift, j[open_] - shift, mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good] - 1
        return low


def _periods(widest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block and each of its periods, from 1 to its widest, in bounded pieces."""
    ends = np.cumsum(widest)
    for at in range(0, int(ends[-1]), PAIRS):
        pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
        block = np.searchsorted(ends, pair, side="right")
        yield block, pair - (ends[block] - widest[block]) + 1


def _crossing(ids: np.ndarray, reach: Extensions, left: np.ndarray, right: np.ndarray, shortest: int, times: int) -> Iterator[np.ndarray]:
    """start, end and period of stretches that cross the middle of a block, as far as they go within it."""
    middle = (left + right) // 2
    for block, p in _periods((right - left) // times):
        l, m, r = left[block], middle[block], right[block]  # noqa: E741
        half = (times * p + 1) // 2 - p  # of a run, one side of the middle holds half: so many words there are equal p apart
        for i, near, fits in ((m, m, m + p + half <= r), (m - p, m - p - half, m - p - half >= l)):
            at = np.flatnonzero(fits)
            first = np.minimum(near[at] + p[at], len(ids) - 1)
            at = at[(half[at] == 0) | (ids[near[at]] == ids[first])]
            at = at[reach.same(near[at], near[at] + p[at], half[at])]
            i, q = i[at], p[at]
            start = i - reach.reach(i, i + q, i - l[at], back=True)
            end = i + q + reach.reach(i, i + q, r[at] - i - q, back=False)
            long = end - start >= np.maximum(shortest, times * q)
            yield np.stack([start[long], end[long], q[long]])


def main_lorentz(ids: np.ndarray, lefts: np.ndarray, rights: np.ndarray, shortest: int = SHORTEST, times: int = TIMES, seed: int = 0) -> np.ndarray:
    """Rows of start, end and smallest period of the runs within the segments from lefts to rights (in order), by start and period."""
    reach, found = Extensions(ids, seed), [np.zeros((3, 0), np.int64)]
    left, right = lefts.astype(np.int64), rights.astype(np.int64)
    while len(left := left[(wide := right - left >= shortest)]):
        right = right[wide]
        found += _crossing(ids, reach, left, right, shortest, times)
        middle = (left + right) // 2
        left, right = np.concatenate([left, middle]), np.concatenate([middle, right])
    start, end, period = np.concatenate(found, axis=1)
    # a stretch that ends where its block does may go on beyond it
    segment = np.searchsorted(lefts, start, side="right") - 1
    before, after = np.maximum(start - 1, 0), np.minimum(end, len(ids) - 1)
    goes_on = (start > lefts[segment]) & (ids[before] == ids[before + period])
    goes_on |= (end < rights[segment]) & (ids[after] == ids[after - period])
    start, end, period = (x[~goes_on] for x in (start, end, period))
    by = np.lexsort([period, end, start])  # the smallest of the periods of one stretch divides the others
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    out = np.stack([start[first], end[first], period[first]], axis=1)
    out = out[np.lexsort([out[:, 2], out[:, 0]])]
    if not all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in out.tolist()):
        return main_lorentz(ids, lefts, rights, shortest, times, seed + 1)
    return out


def segments(covered: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of stretches of covered words of one document, if long enough for a run."""
    cut = np.zeros(len(covered) + 1, bool)
    cut[offsets] = True
    inside = np.concatenate([[False], covered, [False]])
    lefts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    rights = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    long = rights - lefts >= shortest
    return lefts[long], rights[long]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin and end among them."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves an empty word
    ends = np.concatenate([[0], np.cumsum(np.asarray(real))]).astype(np.int64)
    return flat.filter(real), ends[np.asarray(lists.offsets)]


def find_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, order: Order | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, by start and period) and collapsed (the text's words, joined by
    one space, without those that any run contains after its first period) of each row. order, if given, puts the words of a
    document into another order first, or repeats them."""
    if times < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")
    k = overlap(shortest, times)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, offsets = split(batch.column("text"))
        ids = np.asarray(words.dictionary_encode().indices, np.int64)
        places = np.arange(len(ids))
        if order:
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if (own := order(doc, b - a)) is not None:
                    places[a:b] = a + own
            ids = ids[places]
        lefts, rights = segments(repeated(ids, offsets, k), offsets, shortest)
        runs = main_lorentz(ids, lefts, rights, shortest, times)
        start, end, period = runs.T
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, end, -1)
        kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, offsets), pa.int32()), words.take(pa.array(places[kept])))
        own = np.searchsorted(offsets, start, side="right") - 1
        fields = [pa.array(x, pa.int64()) for x in (start - offsets[own], end - start, period)]
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(offsets), pa.int64()), "runs": found, "collapsed": pc.binary_join(lists, " ")})

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(texts_of(docs), schema, lambda: scan)
