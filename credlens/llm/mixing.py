"""Mixing sources to target weights by hash thresholds, DataFrame operations only.

Each source gets a share of all words by weight, at most MOST times its own; what it can't use is shared again among the
others. Every document is taken floor(target / source size) times; for the rest of the target, documents whose hash lies
below a threshold are taken once more. Thresholds come from histograms: words summed by source and hash bucket; buckets
below the budget are in, and only the bucket where the budget ends is cut into smaller buckets, until one document is left
in it, which is in if that brings the sum nearer. No row is sorted, and what any source keeps at a smaller budget it keeps
at a larger one.

Size is the number of words (null text: 0). A null source is a source of its own, the last. Rows that repeat a doc_id have
one hash: they are in or out together. A null doc_id has a hash as well. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, WORD, written

#: The share of all words that the mix has, and the most times a document is taken.
SHARE, MOST = 1.0, 3
#: Hashes have LEVELS * BITS bits; each level of histograms looks at BITS more.
BITS, LEVELS = 10, 6


def word_count(text: Column) -> Column:
    """Words of a text. Each word and the blanks around it become one character."""
    blanks = BLANKS.removesuffix("+") + "*"
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, f"{blanks}{WORD}{blanks}", "x"))).otherwise(0).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of doc_id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """source, source_size, target and times (whole copies of each document). sizes: source, source_size, a row a source.

    With sources ordered by the weight at which they are full, all before one being full tells what a unit of weight is
    worth; the first source that isn't full at its own level sets the level of all.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("full", F.col("source_size") * MOST / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("full", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.min_by(F.when(F.col("full") > F.col("level"), F.col("level")), F.when(F.col("full") > F.col("level"), F.struct("full", "place"))).over(every))
    most = (F.col("source_size") * MOST).cast("double")
    target = F.when((F.col("full") > F.col("level")), F.col("weight") * F.col("level")).otherwise(most)
    out = ranked.select("source", "source_size", F.least(target, most).alias("target"))
    return out.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """source and below: documents of the source with a smaller hash are taken once more.

    sized: source, size, hash. wanted: source, target, source_size, times. Each level's table has a row per source: the
    words taken so far, the range [start, start + width) where the budget ends, and the words and rows in it.
    """
    width = 1 << (BITS * LEVELS)
    state = wanted.where("target > times * source_size").select(
        "source", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("taken"), F.col("source_size").alias("words"), F.lit(2).cast("long").alias("rows"),
    )
    state, done = written(state, "mix-state"), None
    for _ in range(LEVELS):
        width >>= BITS
        ended = state.where("rows <= 1").withColumn("width", F.lit(width << BITS).cast("long"))
        done = ended if done is None else done.unionByName(ended)
        state = state.where("rows > 1")
        if state.isEmpty():
            break
        inside = sized.where("size > 0").join(state.select(F.col("source").alias("of"), "start"), F.col("source").eqNullSafe(F.col("of")))
        inside = inside.where((F.col("hash") >= F.col("start")) & (F.col("hash") - F.col("start") < width << BITS))
        buckets = inside.groupBy("source", F.expr(f"start + ((hash - start) div {width}) * {width}").alias("at")).agg(F.sum("size").alias("in_bucket"), F.count("*").alias("in_rows"))
        upto = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("at"))
        buckets = buckets.withColumn("upto", upto).withColumnRenamed("source", "of")
        over = buckets.join(state, F.col("source").eqNullSafe(F.col("of"))).where("taken + upto > budget")
        first = over.groupBy("source").agg(F.min(F.struct("at", "taken", "upto", "in_bucket", "in_rows", "budget")).alias("b"))
        state = written(
            first.select("source", "b.budget", F.col("b.at").alias("start"), (F.col("b.taken") + F.col("b.upto") - F.col("b.in_bucket")).alias("taken"), F.col("b.in_bucket").alias("words"), F.col("b.in_rows").alias("rows")),
            "mix-state",
        )
    done = done.unionByName(state.withColumn("width", F.lit(width).cast("long")))
    nearer = F.col("taken") + F.col("words") - F.col("budget") < F.col("budget") - F.col("taken")
    return done.select("source", (F.col("start") + F.when(nearer, F.col("width")).otherwise(0)).alias("below"))


def plan(docs: DataFrame, weights: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (doc_id, source, size, hash), and what is taken of each source (of, source_size, target,
    times, below), both written tables."""
    doc_id = F.col("doc_id").cast("long")
    sized = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size"), id_hash(doc_id).alias("hash"))
    sized = written(sized, "mix-sizes")
    wanted = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-targets")
    below = thresholds(sized, wanted).withColumnRenamed("source", "for")
    wanted = wanted.join(below, F.col("source").eqNullSafe(F.col("for")), "left").drop("for").withColumnRenamed("source", "of")
    return sized, written(wanted, "mix-thresholds")


def times(hashed: Column) -> Column:
    """How often a document with that hash is taken, given its source's row of the plan."""
    return F.col("times") + F.when(hashed < F.col("below"), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted) of each row."""
    sized, wanted = plan(docs, weights)
    found = sized.join(wanted, F.col("source").eqNullSafe(F.col("of")))
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times(F.col("hash"))).alias("taken"))


def take(docs: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. Rows stay where they are; the
    sources' plan is joined to them. Rows without words may be left out or taken like others of their hash."""
    _, wanted = plan(docs, weights)
    rows = docs.select(F.struct("*").alias("row"))  # so that no name of docs can clash
    mixed = rows.join(wanted, F.col("row.source").cast("string").eqNullSafe(F.col("of")))
    copies = times(id_hash(F.col("row.doc_id").cast("long"))).cast("int")
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
