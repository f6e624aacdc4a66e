"""Exact dedup by an extendible-hash index, DataFrame operations only.

A text's key is the hash of its normalised bytes. The index's directory has a slot for each prefix of global depth many
bits; it doubles until no bucket holds more than `capacity` keys, and slots whose keys fit together share a bucket of
smaller local depth. Buckets are key ranges, and rows are dealt by bucket in ranges: the task that owns a bucket gets all
its texts whose key is not alone, compares whole bytes, and chains different texts that have one key. A text whose key no
other row has needs no comparison and stays where it is.

Copies are counted before owners get them, within salts: an owner sees a text at most SALTS times, however many copies it
has. Keys, directory and index are Parquet tables in the shared folder. Null text counts as empty. Rows that repeat a doc_id
are one document: each of them counts in group_size and gets the same flags. Rows with a null doc_id count in their group
and stay only if no row of it has a doc_id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, among, texts_of, written

#: Keys in a bucket before it splits.
CAPACITY = 1024
#: A key that more texts share than fit in a bucket can't be split: the directory stops here, and the chain is longer.
MOST_BITS = 40
#: Parts in which copies of one text are counted before its owner gets it.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    """doc_id, text (normalised) and key: the top key_bits bits of its hash."""
    rows = texts_of(docs).select("doc_id", normalised(F.col("text")).alias("text"))
    return rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("text"), 64 - key_bits) if key_bits < 64 else F.xxhash64("text"))


def slot(key: Column, key_bits: int, depth: int) -> Column:
    return F.shiftrightunsigned(key, key_bits - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, key_bits: int, capacity: int) -> tuple[DataFrame, int]:
    """slot, bucket and depth (local) for each slot with keys, and the global depth. keys: one row per key."""
    total = keys.count()
    depth, most = min(max(0, math.ceil(math.log2(max(1, total) / capacity))), key_bits, MOST_BITS), min(key_bits, MOST_BITS)
    while True:
        slots = written(keys.groupBy(slot(F.col("key"), key_bits, depth).alias("slot")).agg(F.count("*").alias("n")), "slots")
        if depth >= most or (slots.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth += 1  # the directory doubles
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    prefix = F.expr(f"shiftrightunsigned(slot, {depth} - depth)").alias("prefix")
    fits = levels.groupBy("depth", prefix).agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == depth))
    found = levels.select("slot", "depth", prefix).join(fits.drop("n"), ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    # a bucket's number is its first slot, so that numbers follow the keys
    bucket = F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)")
    return written(found.select("slot", bucket.alias("bucket"), "depth"), "directory"), depth


def in_bucket(rows: DataFrame, slots: DataFrame, key_bits: int, depth: int) -> DataFrame:
    """rows with the bucket that the directory gives for their key."""
    return rows.withColumn("slot", slot(F.col("key"), key_bits, depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")


def chained(texts: DataFrame, slots: DataFrame, key_bits: int, depth: int) -> DataFrame:
    """The index's entries for rows of doc_id, key and text: one for each different text. Grouping and chaining need no
    other exchange than the one that deals rows to owners by ranges of buckets."""
    salted = in_bucket(texts, slots, key_bits, depth).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    counted = salted.groupBy("bucket", "key", "text", "salt").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    owned = counted.repartitionByRange("bucket").groupBy("bucket", "key", "text").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256"))
    return owned.select("bucket", "key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size").withColumn("chain", place)


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The keys of all rows (doc_id, key, text_sha256), and the index, written by ranges of buckets: a row for each different
    text, with bucket, key, chain (its place among the texts of its key, from 1), text_sha256, keep_id and group_size."""
    texts = keyed(docs, key_bits)
    keys = written(texts.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "keys")
    by_key = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "by-key")
    slots, depth = directory(by_key.select("key"), key_bits, capacity)
    repeated = among(texts, by_key.where("n > 1").select(F.col("key").alias("id")), "key", keep=True)
    alone = in_bucket(by_key.where("n = 1"), slots, key_bits, depth).repartitionByRange("bucket")
    alone = alone.select("bucket", "key", "text_sha256", "keep_id", F.lit(1).cast("long").alias("group_size"), F.lit(1).alias("chain"))
    return keys, written(chained(repeated, slots, key_bits, depth).unionByName(alone), "index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs."""
    keys, index = build_index(docs, capacity, key_bits)
    # texts that stand alone need no look-up; a hot key splits here by AQE's skew join: its index side is one row
    groups = index.where("group_size > 1").select("key", "text_sha256", F.struct("keep_id", "group_size").alias("g"))
    found = keys.join(groups, ["key", "text_sha256"], "left")
    keep_id = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("g.keep_id"))
    found = found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("g.group_size", F.lit(1)).alias("group_size"), "text_sha256")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows with a null doc_id stay."""
    gone = exact_dedup(docs, capacity).where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return among(docs, written(gone, "gone"), "doc_id", keep=False)
