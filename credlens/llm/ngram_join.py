"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document's set holds the hashes (64 bits) of its word n-grams. Tokens have one order everywhere: rare ones first, then
frequent ones by frequency, ties by hash. Two sets that link share enough tokens in a prefix of each, so that prefixes are
what is indexed: a rare token alone, frequent tokens in pairs. A pair is made of two frequent tokens in the same of m slots
(by hash), and prefixes are longer by m tokens, so that of the tokens shared there two must be in one slot. Candidates
must still be able to share enough, by their sizes, their tokens' places, and how many of their prefix tokens no other
set has; what is left is verified on whole sets.

Which tokens are frequent is read from a table of counters, which every document's tokens are counted in; the order need
not be exact, only the same everywhere. The counters' number doesn't grow with the input: a rare token's counter is within
three deviations of the mean, so that its true count, and its bucket, grow with the square root of the tokens a counter
has. Equal sets are one class with one representative. In a bucket no pairs are listed at first: each member is held against a
pivot, the member with the fewest rare tokens; then members that aren't yet connected against pivots by hash; and only
pairs of different components that could still link are listed in the end. So a group of near copies costs as many
verifications as it has members, and no link between components is lost.

Null text counts as empty. Empty sets link with nothing. Rows repeating a doc_id are one document that has the sets of all of
them. A row with a null doc_id gets the component of the sets equal to its own, null where no row with a doc_id has one; it
links nothing else. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import MULTIPLIER, mixed, shingle_sets
from .common import among, released, slices, texts_of, written
from .components import components

WORDS = 5
#: Counters of the frequency table, in PARTS pieces: 16 MB in all, whatever the input.
COUNTERS, PARTS = 1 << 22, 64
#: A set's size class j holds sizes from 2^j; its pairs have 2^j / SLOT slots (none below SLOT: frequent tokens stand alone).
SLOT = 16
#: Sizes in one bin differ by this factor at most.
BIN = 1.06
#: Bytes of a batch of pairs, with two whole sets a row, that is worked on at once.
PAIRS = 8 << 20
#: Parts of a frequent signature's rows in the first shuffle.
SALTS = 16


def profile(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: doc_id, n and cls (a digest of the set) for each document; part and counts for each task's
    counters. A task counts equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(COUNTERS, np.uint32), set()
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, digests = [], []
            for tokens in shingle_sets(batch.column("text"), WORDS):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                sizes.append(len(tokens))
                digests.append(digest)
                if digest not in seen:
                    seen.add(digest)
                    counters[(tokens >> np.uint64(42)).astype(np.int64)] += np.uint32(1)  # tokens of one set in one counter count once
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if counters.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in np.split(counters, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return texts_of(docs).mapInArrow(released(run), "doc_id long, n long, cls binary, part int, counts binary")


def levels(parts: DataFrame) -> np.ndarray:
    """Each counter's level: 0 for rare tokens, else by its logarithm. Tasks add the pieces up as a stream, first within
    salts; the driver gets the sums, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(data), np.uint32)
                sums[part] = np.minimum(sums[part].astype(np.uint64) + counts, 0xFFFFFFFF).astype(np.uint32) if part in sums else counts
        for part, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": [zlib.compress(counts.tobytes(), 1)]})

    salted = parts.select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt")).repartition("part", "salt")
    summed = salted.select("part", "counts").mapInArrow(released(run), "part int, counts binary").repartition("part").mapInArrow(released(run), "part int, counts binary")
    counters = np.zeros(COUNTERS, np.float64)
    width = COUNTERS // PARTS
    for row in summed.toLocalIterator():
        counters[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    usual = counters.mean()
    return np.where(counters > usual + 3 * usual**0.5 + 4, 1 + np.log2(np.maximum(counters, 1)), 0).astype(np.uint8)


def signatures(tokens: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(signatures, reach, frequent) arrays of one set. Reach is the most tokens that the set can share with another, if
    a signature is the first they share: places after it, itself, and for pairs those that slots may leave out before."""
    n = len(tokens)
    own = level[(tokens >> np.uint64(42)).astype(np.int64)]
    rare = int((own == 0).sum())
    if rare < n:
        tokens = tokens[np.argsort(own, kind="stable")]
    spare = n - -(-3 * n // 4)  # tokens that a partner may lack
    alone = min(rare, spare + 1)
    out = [(tokens[:alone], n - np.arange(alone), False)]
    if rare > spare:
        return out
    size_class = n.bit_length() - 1
    for j in (size_class, size_class - 1):
        if j < size_class and (j < 0 or -(-3 * n // 4) >= 1 << size_class):
            continue  # no partner is of the smaller class
        m = (1 << j) // SLOT
        at = np.arange(rare, min(n, spare + 1 + m))
        some = tokens[at]
        if not m:
            out.append((mixed(some + np.uint64(j)), n - at, True))
            continue
        slots = ((some >> np.uint64(8)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        ends = np.cumsum(np.bincount(slots, minlength=m))
        first, second, start = [], [], 0
        for end in ends.tolist():
            members = order[start:end]
            if len(members) > 1:
                x, y = np.triu_indices(len(members), 1)
                first.append(members[x])
                second.append(members[y])
            start = end
        if first:
            x, y = np.concatenate(first), np.concatenate(second)
            # sets that share a rare token meet there: those that meet here share none of them
            out.append((mixed(mixed(some[x] + np.uint64(j)) * MULTIPLIER + some[y]), np.minimum(n - at[y] + m, n - rare), True))
    return out


SIGNATURES = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("reach", pa.int32()), ("rare", pa.int32()), ("frequent", pa.bool_())])


def signature_rows(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """sig, doc_id, n, reach, rare (rare tokens in the prefix) and frequent. A task leaves out sets that it has had."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            found: list[tuple[np.ndarray, np.ndarray]] = []
            about: list[tuple[int, int, int, int, bool]] = []  # how many signatures, and what they have in common
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), WORDS), strict=True):
                if not len(tokens) or doc_id is None or (digest := hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(digest)
                for sigs, reach, frequent in (made := signatures(tokens, shared.value)):
                    found.append((sigs, reach))
                    about.append((len(sigs), doc_id, len(tokens), len(made[0][0]), frequent))
            if found:
                times, ids, n, rare, frequent = (np.array(x) for x in zip(*about, strict=True))
                columns = [np.concatenate([x for x, _ in found]).view(np.int64), np.repeat(ids, times), np.repeat(n, times), np.concatenate([x for _, x in found]), np.repeat(rare, times), np.repeat(frequent, times)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype(), copy=False)) for c, f in zip(columns, SIGNATURES, strict=True)], schema=SIGNATURES)

    return texts_of(docs).mapInArrow(released(run), "sig long, doc_id long, n int, reach int, rare int, frequent boolean")


def members(docs: DataFrame, level: np.ndarray, classes: DataFrame) -> DataFrame:
    """sig, rep, n, reach, rare and bin: the signatures that sets share.

    One pass makes all signatures, and one shuffle brings equal ones together, frequent ones in SALTS parts; rare ones that
    no other set has go there and then. A set can't share those, wherever they stand: reach counts them out, and of the
    others each that stands before.
    """
    rows = signature_rows(docs, level)
    salt = F.when(F.col("frequent"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    counted = rows.withColumn("salt", salt).withColumn("others", F.count("*").over(Window.partitionBy("sig", "salt")))
    shared = written(counted.where("frequent or others > 1").drop("salt", "others"), "signatures")
    # rare tokens' buckets are as small as their counters say; frequent pairs are counted before the shuffle
    pairs = shared.where("frequent")
    often = pairs.groupBy("sig").count().where("count > 1").select("sig")
    of_doc = Window.partitionBy("doc_id")
    alone = shared.where("not frequent").withColumn("known", F.count("*").over(of_doc))
    place = F.row_number().over(of_doc.orderBy(F.col("reach").desc())) - 1
    alone = alone.withColumn("reach", (F.col("n") - F.col("rare") + F.col("known") - place).cast("int")).drop("known")
    found = alone.unionByName(pairs.join(often, "sig")).join(classes.select("doc_id", "rep").distinct(), "doc_id")
    found = found.groupBy("sig", "rep", "n").agg(F.max("reach").alias("reach"), F.max("rare").alias("rare"))
    size_bin = F.floor(F.log("n") / float(np.log(BIN))).cast("int")
    return written(found.where("4 * reach >= 3 * n").withColumn("bin", size_bin), "members")


#: Whether two members can link: 7 * shared >= 3 * (n + n) is what a Jaccard of 3/4 takes.
CAN_LINK = "7 * least(x.reach, y.reach) >= 3 * (x.n + y.n) and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)"


def star_pairs(rows: DataFrame, by: str) -> DataFrame:
    """Distinct candidate pairs a < b of bucket members and their pivot: in each bucket and size bin the member with the
    least `by`; and of the bins' pivots and the bucket's."""
    pivot = F.min(F.struct(F.expr(by).alias("by"), F.col("rep"), F.col("n"), F.col("reach"))).alias("p")
    flat = [F.col(f"p.{c}").alias(c) for c in ("by", "rep", "n", "reach")]
    binned = rows.groupBy("sig", "bin").agg(pivot).select("sig", "bin", *flat)
    top = binned.groupBy("sig").agg(F.min(F.struct("by", "rep", "n", "reach")).alias("p")).select("sig", *flat)
    pair = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    within = rows.alias("x").join(binned.alias("y"), ["sig", "bin"]).where(f"x.rep <> y.rep and {CAN_LINK}").select(*pair)
    across = binned.alias("x").join(top.alias("y"), "sig").where(f"x.rep <> y.rep and {CAN_LINK}").select(*pair)
    return within.unionAll(across).distinct()


def other_pairs(rows: DataFrame) -> DataFrame:
    """Distinct candidate pairs a < b of members in different components. The larger one looks in the bins that hold the
    sizes it can link with.

    Members with the same buckets, places and size (of a common passage and little else) meet in each of those buckets; so one
    stands for all of them (`pattern`), and pairs of patterns, each once, are turned into pairs of members in the end."""
    digest = [F.sum(F.xxhash64("sig", "reach", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]
    like = rows.groupBy("rep", "component", "n").agg(*digest)
    patterns = like.groupBy("n", "h1", "h2").agg(F.min("rep").alias("pattern"), F.min("component").alias("low"), F.max("component").alias("high"))
    patterns = written(patterns, "patterns")
    held = written(like.join(patterns, ["n", "h1", "h2"]).select("rep", "component", "pattern"), "members")
    rows = rows.join(patterns.select(F.col("pattern").alias("rep"), "n", "low", "high"), ["rep", "n"])
    log = float(np.log(BIN))
    low, high = F.floor(F.log(F.col("n") * 0.75) / log) - 1, F.floor(F.log(F.least(F.col("n"), (F.col("reach") * 7.0 / 3.0) - F.col("n")) + 0.5) / log) + 1
    looking = rows.where("7 * reach >= 5.25 * n").withColumn("bin", F.explode(F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))))
    standing = rows.where("7 * reach >= 6 * n")
    apart = "(x.low <> x.high or y.low <> y.high or x.low <> y.low)"
    condition = F.expr(f"x.sig = y.sig and x.bin = y.bin and {apart} and (x.n > y.n or x.n = y.n and x.rep >= y.rep) and {CAN_LINK}")
    found = looking.alias("x").join(standing.alias("y"), condition).select(F.col("x.rep").alias("p"), F.col("y.rep").alias("q")).distinct()
    x = held.select(F.col("pattern").alias("p"), F.col("rep").alias("x"), F.col("component").alias("x_component"))
    y = held.select(F.col("pattern").alias("q"), F.col("rep").alias("y"), F.col("component").alias("y_component"))
    pairs = found.join(x, "p").join(y, "q").where("x_component <> y_component and (p <> q or x < y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs that link, by their whole sets."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "ids")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.tobytes() for t in shingle_sets(batch.column("text"), WORDS)], pa.binary())], ["id", "tokens"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, PAIRS)):
            good = []
            for x, y in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= 75 * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = written(among(texts_of(docs), ids, "doc_id", keep=True).mapInArrow(released(sets_of), "id long, tokens binary").distinct(), "sets")
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t")
    return written(both.mapInArrow(released(check), "a long, b long").distinct(), "links")


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows of buckets that hold several components, with each member's component."""
    rows = rows.drop("component").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep"))
    mixed_buckets = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    return written(rows.join(mixed_buckets, "sig"), "members")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs: the smallest doc_id reachable by links."""
    rows = written(profile(docs), "profile")
    sets = rows.where("part is null").select("doc_id", "n", "cls")
    level = levels(rows.where("part is not null"))
    # classes of several rows have a representative; joined as a table of its own, so that a hot class can be split
    reps = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1")
    reps = written(reps.select("cls", "rep"), "reps")
    full = sets.where("n > 0").join(reps, "cls", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    classes = written(full.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))), "classes")
    several = classes.where("n > 0").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    same = written(several.join(classes.where("n > 0"), "doc_id").select("a", F.col("rep").alias("b")).distinct(), "links")  # a doc_id's classes
    buckets = members(docs, level, classes.where("n > 0"))
    links = same.unionAll(verified(docs, star_pairs(buckets, "rare")))
    for pairs in (lambda rest: star_pairs(rest, "xxhash64(rep, sig)"), other_pairs):
        found = components(links)
        rest = labelled(buckets, found)
        more = verified(docs, pairs(rest))
        links = written(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more), "links")
    found = components(links).withColumnRenamed("id", "rep")
    component = F.coalesce(F.col("component"), F.col("rep"))
    return classes.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group, the document with the smallest doc_id. Rows
    with a null doc_id stay."""
    gone = join_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    return among(docs, written(gone, "gone"), "doc_id", keep=False)
