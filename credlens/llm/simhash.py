"""Near-duplicates by SimHash: fingerprints, and exact pairs within a Hamming distance from vantage-point trees.

A text's words are lower-cased (A-Z) and joined in shingles, repeats included; fewer words are one shingle. A bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Equal fingerprints are one row before anything is compared. The upper levels of a vantage-point tree, grown from a bounded
sample, deal the different fingerprints to shards (each is at home in one), and send those near a boundary to ask in the shards
beyond it as well; shards that turn out too large are sampled and split again. In its task a shard goes on with a tree of its
own. It returns a link for each fingerprint that it connects to another, not all pairs, so that a group of near copies gives as
many rows as it has fingerprints; `near_pairs` gives all pairs of different fingerprints. No pair is lost: all that is left out
is ruled out by the triangle inequality, or is connected already.

Null and empty texts have fingerprint 0, and are linked like any other. Rows that repeat a doc_id are one document's, each with
its own fingerprint. Rows with a null doc_id take part; they count as no document's smallest id, so that a component of such
rows alone has a null id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, map_batches, released, texts_of, written
from .components import components
from .vantage import Tree, links, pairs

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints at home in a shard, about; shards that a table is dealt to at least (if it has 64 fingerprints for each).
SHARD, LEAST = 1 << 15, 64
#: Fingerprints that the driver samples at most (8 bytes each), sampled for each shard, and times that large shards are split.
SAMPLE, EACH, ROUNDS = 1 << 20, 64, 4


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of a text, in order."""
    found = text.lower().split()  # of bytes: A-Z, ASCII white space
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else []
    line = b" ".join(found)
    starts = list(accumulate((len(w) + 1 for w in found), initial=0))
    return [xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, starts[words:], strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return bits


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of each row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.zeros(batch.num_rows, np.uint64)
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            if found := shingle_hashes(text, words):
                bits = 2 * majority(np.array(found, np.uint64)) > len(found)
                out[i] = np.packbits(bits, bitorder="little").view("<u8")[0]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fingerprint": out.view(np.int64)})

    return map_batches(texts_of(docs), "doc_id long, fingerprint long", lambda: one)


def _places(prints: DataFrame, tree: Tree, r: int | None) -> DataFrame:
    """shard, fingerprint and home for each place that a fingerprint has: one at home, and those where it asks."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = np.asarray(batch.column("fingerprint"), np.int64)
            for leaf, home, ask in tree.route(x.view(np.uint64), r):
                at = np.concatenate([home, ask])
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(at), leaf), "fingerprint": x[at], "home": np.arange(len(at)) < len(home)})

    return prints.select("fingerprint").mapInArrow(released(run), "shard long, fingerprint long, home boolean")


def grow_tree(prints: DataFrame, r: int, shard: int = SHARD) -> Tree:
    """A tree whose leaves have about `shard` fingerprints at most, as far as splits save work."""
    n = prints.count()
    tree, sizes = Tree(), {0: n}
    shard = max(EACH, min(shard, -(-n // LEAST)))
    for _ in range(ROUNDS):
        large = {leaf: size for leaf, size in sizes.items() if size > 2 * shard}
        if not large:
            break
        share = min(1.0, EACH / shard, SAMPLE / sum(large.values()))
        place = _places(prints.where(F.pmod(F.xxhash64("fingerprint", F.lit(tree.leaves)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))), tree, None)
        sample = place.where(F.col("shard").isin(list(large))).select("shard", "fingerprint").limit(2 * SAMPLE).toPandas()
        before = tree.leaves
        for leaf, own in sorted(sample.groupby("shard")["fingerprint"]):
            tree.split(int(leaf), np.sort(own.to_numpy(np.int64).view(np.uint64)), share * shard, r)
        if tree.leaves == before:
            break
        counted = _places(prints, tree, None).groupBy("shard").count().collect()  # a row a shard
        sizes = {x["shard"]: x["count"] for x in counted}
    return tree


def _joined(prints: DataFrame, r: int, shard: int, every: bool) -> DataFrame:
    """a and b: links between different fingerprints that connect what is within r, or all such pairs."""

    def join(table: pa.Table) -> pa.Table:
        x, home = np.asarray(table.column("fingerprint"), np.int64), np.asarray(table.column("home"))
        x = x[np.lexsort([x, ~home])]  # members first
        found = pairs(x.view(np.uint64), int(home.sum()), r) if every else iter([links(x.view(np.uint64), int(home.sum()), r)])
        a, b = (np.concatenate([np.zeros(0, np.int64), *p]) for p in zip(*found, strict=True)) if home.any() else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": x[a], "b": x[b]})

    placed = _places(prints, grow_tree(prints, r, shard), r)
    return placed.groupBy("shard").applyInArrow(join, "a long, b long")


def near_pairs(docs: DataFrame, r: int = RADIUS, words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """a, b (different fingerprints within r, each pair once) and their distance."""
    prints = written(fingerprints(docs, words).select("fingerprint").distinct(), "prints")
    found = _joined(prints, r, shard, every=True)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def near_duplicates(docs: DataFrame, r: int = RADIUS, words: int = WORDS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id that is reachable) of each row."""
    every = written(fingerprints(docs, words), "fingerprints")
    prints = written(every.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    linked = components(_joined(prints, r, shard, every=False))
    member = written(linked.unionAll(linked.select(F.col("component").alias("id"), "component").distinct()), "members")
    named = member.join(prints, F.col("id") == F.col("fingerprint")).groupBy("component").agg(F.min("least").alias("named"))
    member = member.join(named, "component").select(F.col("id").alias("fingerprint"), F.struct("named").alias("linked"))
    own = prints.join(member, "fingerprint", "left").select("fingerprint", F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("linked.named")).alias("component_id"))
    # a fingerprint that many rows have is split by AQE: it has one row on the other side
    return every.join(written(own, "named"), "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def as_hex(fingerprint: str) -> F.Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
