"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

A vector is a sparse row of integer weights, its components being the terms. Candidates and queries are packed into blocks
of bounded size; each pair of a query block and a candidate block is one row of work, so that no task holds more than two
blocks and a score array, whatever the number of vectors. All pairs of blocks have to meet; large blocks keep the bytes that
this moves small, and inside them tiles of rows meet one after another. In a tile each term has a posting list (positions
and weights). For each term, the query rows' weights are multiplied with the postings and scattered into dense score
arrays; partition selection keeps what reaches the k-th score, once a tile and once a block, and a window merges the blocks'
results exactly.

Vectors that are null, or hold a null or a non-finite component, or one beyond 2^53 / scale, take no part. Shorter vectors lack
the later terms. Equal scores rank by smaller id; rows repeating an id are separate candidates (none is its own query's), and
separate queries if their weights differ: such an id has several rankings. A null id takes no part. Empty tables give an empty
result. Weights and scores are 64-bit integers; scores beyond that are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Weights and ids that a block holds (8 bytes each; one vector at least), rows of a tile of candidates and of queries, and
#: cells of a tile (one row at least).
CELLS = 1 << 20
CANDIDATES, QUERIES, TILE = 4096, 512, 1 << 20


def sparse_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """id and weights (array of long): floor(scale * component) of each vector that takes part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v * float(scale)) >= float(1 << 53)))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("weights"))


def _packed(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Blocks of up to that many weights and ids: rows' numbers, ids, lengths, and weights, as bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    used = 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({name: [b"".join(x.tobytes() for x in parts)] for name, parts in zip(("numbers", "ids", "lengths", "flat"), zip(*held, strict=True), strict=True)})

    for batch in batches:
        weights = batch.column("weights")
        lengths = np.asarray(pc.list_value_length(weights), np.int64)
        flat = np.asarray(weights.flatten(), np.int64)
        numbers, ids = (np.asarray(batch.column(c), np.int64) for c in ("number", "id"))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        size = np.concatenate([[0], np.cumsum(lengths + 1)])
        at = 0
        while at < len(ids):
            to = int(np.searchsorted(size, size[at] + cells - used, side="right")) - 1
            if to <= at and not used:
                to = at + 1
            if to > at:
                held.append((numbers[at:to], ids[at:to], lengths[at:to], flat[ends[at] : ends[to]]))
                used += int(size[to] - size[at])
                at = to
            if at < len(ids):
                yield block()
                held, used = [], 0
    if held:
        yield block()


def blocks(rows: DataFrame, cells: int, name: str) -> DataFrame:
    """Numbered blocks of rows of number, id and weights. Blocks' numbers come from partitions, no rows are gathered."""
    packed = rows.select("number", "id", "weights").mapInArrow(lambda batches: _packed(batches, cells), "numbers binary, ids binary, lengths binary, flat binary")
    return written(packed.withColumn(name, F.monotonically_increasing_id()), name)


def _tiles(numbers: bytes, ids: bytes, lengths: bytes, flat: bytes, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block's tiles: numbers, ids, and a dense (rows, terms) array that has 0 where a row lacks a term."""
    numbers, ids, every, values = (np.frombuffer(x, np.int64) for x in (numbers, ids, lengths, flat))
    ends, at = np.concatenate([[0], np.cumsum(every)]), 0
    while at < len(every):
        widest = np.maximum.accumulate(every[at : at + rows])
        n = every[at : at + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), TILE, side="right")))]
        out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values[ends[at] : ends[at] + len(row)]
        yield numbers[at : at + len(n)], ids[at : at + len(n)], out
        at += len(n)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of every query row against every candidate row, a term at a time."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    largest = [int(np.abs(x).max(initial=0)) for x in (queries, candidates)]
    if largest[0] * largest[1] * min(queries.shape[1], candidates.shape[1]) >= 1 << 63:  # 64 bits may not hold the sums
        queries, candidates, scores = queries.astype(object), candidates.astype(object), scores.astype(object)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        at = np.flatnonzero(candidates[:, term])  # the term's postings
        with_term = np.flatnonzero(queries[:, term])
        if len(at) == len(candidates) and len(with_term) == len(queries):
            scores += np.multiply.outer(queries[:, term], candidates[:, term])
        elif len(at) and len(with_term):
            scores[np.ix_(with_term, at)] += np.multiply.outer(queries[with_term, term], candidates[at, term])
    return np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64) if scores.dtype == object else scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best of one query's scores, ties to smaller ids, without rows of the query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        some = scores[at]
        kth = np.partition(some, len(some) - k)[len(some) - k]
        above = at[some > kth]
        level = at[some == kth]
        return np.concatenate([above, level[np.argsort(ids[level], kind="stable")[: k - len(above)]]])
    return at


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each row of work, the k best candidates of the block for each query."""
    for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
        for numbers, qids, queries in _tiles(row["q_numbers"], row["q_ids"], row["q_lengths"], row["q_flat"], QUERIES):
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qids]
            for _, ids, candidates in _tiles(row["numbers"], row["ids"], row["lengths"], row["flat"], CANDIDATES):
                scores = accumulate(queries, candidates)
                for i, q in enumerate(qids):
                    at = select(scores[i], ids, q, k)
                    found[i].append((ids[at], scores[i, at]))
            best = []
            for number, q, parts in zip(numbers, qids, found, strict=True):
                ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = select(scores, ids, q, k)
                best.append((np.repeat(number, len(at)), np.repeat(q, len(at)), ids[at], scores[at]))
            number, query, vec, score = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_pydict({"number": number, "query_id": query, "vec_id": vec, "score": score})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each row that is_query (a condition on id) holds for.

    Rows that repeat a query's id and weights are searched once."""
    rows = sparse_rows(vectors, scale)
    candidates = blocks(rows.withColumn("number", F.lit(0).cast("long")), cells, "block")
    asked = written(rows.where(is_query).distinct().withColumn("number", F.monotonically_increasing_id()), "asked")
    queries = blocks(asked, cells, "query_block")
    queries = queries.select("query_block", F.col("numbers").alias("q_numbers"), F.col("ids").alias("q_ids"), F.col("lengths").alias("q_lengths"), F.col("flat").alias("q_flat"))
    # the work list, a row for each pair of blocks: blocks are numbered, and a candidate block takes its turn with each query block
    n = queries.count()
    numbers = queries.select("query_block", (F.row_number().over(Window.orderBy("query_block")) - 1).alias("turn"))  # a row a block of queries
    turns = candidates.select("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("turn")) if n else candidates.select("block", F.lit(0).alias("turn"))
    work = turns.join(numbers, "turn").join(candidates, "block").join(queries, "query_block")
    found = work.select("q_numbers", "q_ids", "q_lengths", "q_flat", "numbers", "ids", "lengths", "flat").mapInArrow(lambda batches: _search(batches, k), "number long, query_id long, vec_id long, score long")
    # a query's rows here number k a block; a first rank within salts keeps a task's share small
    best = [F.col("score").desc(), F.col("vec_id")]
    salted = Window.partitionBy("number", "salt").orderBy(*best)
    found = found.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*best))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
