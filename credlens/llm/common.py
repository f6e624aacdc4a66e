"""What several operators share: reading tables, shared folders, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written as written

#: ASCII white space, as the operators' contracts spell it.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that is worked on at once; larger ones are halved.
AT_ONCE = 1 << 20


def slices(batch: pa.RecordBatch, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most that many bytes, or of one row."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker gives its memory back to the system: it stays, and others start beside it."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()  # memos that refer to themselves go too
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed otherwise
            trim(0)

    return whole


#: Bytes of a batch that Spark hands to a task's Python worker, at most.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Spark's batches of 64 MB (held by the JVM, the pipe and the worker at once) are made smaller in this session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b", "64MB"):
        spark.conf.set(name, f"{BATCH}b")


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with state made once a task: make() returns the function that maps each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                yield from map(one, slices(batch))

    small_batches(df.sparkSession)
    return df.mapInArrow(released(run), schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of any name can't clash; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: Ids that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000


def among(df: DataFrame, ids: DataFrame, key: str, keep: bool) -> DataFrame:
    """The rows of df whose key is (keep) or isn't among ids, a table of distinct ids in column `id`. Few ids are broadcast, so that
    rows with whole texts stay where they are. A null key is never among them."""
    name = max(df.columns, key=len) + "_id"  # longer than any of df's
    ids = ids.select(F.col("id").alias(name))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    return df.join(ids, F.col(key).cast("long") == F.col(name), "left_semi" if keep else "left_anti")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text (null: empty), modulo n: the split into learning and held-out rows."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: Values of a column that are learned, at most, and rows of a sample.
MOST_VALUES, MOST_ROWS = 1024, 50_000


def bounded_sample(rows: DataFrame, by: str, each: int) -> DataFrame:
    """About `each` rows of every value of `by` (all, if there are fewer; less, if MOST_ROWS would be exceeded), the same ones
    in each run; at most twice as many in all. Rows are chosen by the hash of doc_id, without a sort of the table. More than
    MOST_VALUES values are an error: none is left out."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).count()
    values = counts.limit(MOST_VALUES + 1).count()
    if values > MOST_VALUES:
        raise ValueError(f"{by} has more than {MOST_VALUES} values")
    each = max(1, min(each, MOST_ROWS // max(1, values)))
    share = counts.select(F.col(by).alias("_value"), (F.lit(each) / F.col("count")).alias("_share"))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.join(F.broadcast(share), F.col(by) == F.col("_value")).where(spread < F.col("_share")).drop("_value", "_share")
    return chosen.orderBy(spread, "doc_id").limit(2 * each * max(1, values))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """doc_id, text and label of a bounded sample of labelled documents (about `each` rows of either label)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(bounded_sample(known, "label", each))  # at most 4 * each rows of two numbers
    return texts_of(docs).join(chosen, "doc_id")
