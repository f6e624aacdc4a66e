"""CSV records from splits of files, line breaks in quotes included.

A task that reads a split can't tell whether its first line begins inside of quotes. But a line is a map of two states (outside,
inside) to two states, and so is a split: such maps compose. A first pass finds each split's map and how many records begin in
it, from either state; windows over the table of splits (a row a split) give the state and the record number that each split begins
with; a second pass cuts records. What a split holds of a record begun before it is kept by the first pass, and joined to the
record's beginning; it may span any number of splits.

Lines end with \\n or \\r\\n. A quote opens a value only at its beginning; two quotes in a value are one. Lines without anything
but white space, outside of quotes, are no records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import written

#: Characters of continued records that are broadcast at most; more are joined by a shuffle of the records they belong to.
BROADCAST = 1 << 24
#: Bytes of a text in memory that are dealt with as one split.
CHUNK = 1 << 20


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value, file and block (where the split begins) of each line, in the order of the file within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def lines_in(spark: SparkSession, text: str, chunk: int = CHUNK) -> DataFrame:
    """The same of a text in memory."""
    lines, chunks, size = text.split("\n"), [[]], 0
    for line in lines[: -1 if lines[-1] == "" else None]:
        if size > chunk:
            chunks.append([])
            size = 0
        chunks[-1].append(line)
        size += len(line) + 1
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(chunks)], "block long, lines array<string>")
    return rows.select(F.explode("lines").alias("value"), F.lit("").alias("file"), "block")


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the line's end is inside of quotes, if its beginning is or isn't."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('""', quote):
                at = quote + 2
                continue
            inside, at = False, quote + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        comma = line.find(delimiter, at)
        if comma < 0:
            return False
        at = comma + 1


Piece = tuple[tuple[str, int], pa.RecordBatch]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """The batches cut where another split begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, block = batch.column("file").dictionary_encode(), np.asarray(batch.column("block"))
        index = np.asarray(files.indices)
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(index) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield (files.dictionary[int(index[a])].as_py(), int(block[a])), batch.slice(a, b - a)


def _filled(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(values)), 0))


class Survey:
    """What the lines of one split do, from either state."""

    def __init__(self) -> None:
        self.state, self.starts, self.lead, self.open = [False, True], [0, 0], [], True

    def add(self, values: pa.Array, delimiter: str) -> None:
        if not pc.any(pc.match_substring(values, '"')).as_py():
            filled = int(_filled(values).sum())
            if self.open:
                self.lead += values.to_pylist()
            self.starts = [n + (0 if s else filled) for n, s in zip(self.starts, self.state, strict=True)]
            return
        for line in values.to_pylist():
            if self.open:
                self.lead.append(line)
            for k in (0, 1):
                if not self.state[k] and line.strip():
                    self.starts[k] += 1
                self.state[k] = ends_inside(line, self.state[k], delimiter)
            self.open = self.open and self.state[1]


def survey(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Of each split: file, block, end0 and end1 (whether it ends inside, from outside and inside), starts0 and starts1 (records
    that begin in it), lead (what it holds of a record that it begins inside of)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None

        def told() -> pa.RecordBatch:
            out = {"file": key[0], "block": key[1], "end0": now.state[0], "end1": now.state[1], "starts0": now.starts[0], "starts1": now.starts[1], "lead": "\n".join(now.lead)}
            return pa.RecordBatch.from_pylist([out])

        for at, piece in _pieces(batches):
            if at != key:
                if now:
                    yield told()
                now, key = Survey(), at
            now.add(piece.column("value"), delimiter)
        if now:
            yield told()

    return lines.mapInArrow(run, "file string, block long, end0 boolean, end1 boolean, starts0 long, starts1 long, lead string")


def placed(splits: DataFrame) -> DataFrame:
    """splits with inside (whether a split begins inside of quotes), starts, first (the number of its first record), head (of
    its file's first record) and heads (files that have records up to here)."""
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.when(F.col("end0") & ~F.col("end1"), 1).otherwise(0)
    upto = F.sum(flips).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    splits = splits.withColumn("fixed", F.when(F.col("end0") == F.col("end1"), F.struct("end0", upto.alias("flips"))))
    last, flipped = F.last("fixed", ignorenulls=True).over(before), F.coalesce(F.sum(flips).over(before), F.lit(0))
    odd = (flipped - F.coalesce(last["flips"], F.lit(0))) % 2 == 1
    splits = splits.withColumn("inside", F.coalesce(last["end0"], F.lit(False)) != odd)
    splits = splits.withColumn("starts", F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0")))
    order = Window.orderBy("file", "block")  # a row a split
    splits = splits.withColumn("first", F.sum("starts").over(order) - F.col("starts"))
    splits = splits.withColumn("head", F.min("first").over(Window.partitionBy("file")))
    opens = ((F.col("first") == F.col("head")) & (F.col("starts") > 0)).cast("int")
    return splits.withColumn("heads", F.sum(opens).over(order)).drop("fixed")


def _cut(delimiter: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records that begin in each split: place, file_row (from 0, the header), row, open (whether it goes on beyond) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, place, held, heads, head = None, False, 0, [], 0, 0

        def out(texts: list[str], going_on: bool = False) -> pa.RecordBatch:
            at = np.arange(place, place + len(texts))
            return pa.RecordBatch.from_pydict({"place": at, "file_row": at - head, "row": at - heads, "open": np.full(len(at), going_on), "text": pa.array(texts, pa.string())})

        for at, piece in _pieces(batches):
            if at != key:
                if held:
                    yield out(["\n".join(held)], True)
                one = piece.slice(0, 1).to_pylist()[0]
                key, inside, place, held, heads, head = at, one["inside"], one["first"], [], one["heads"], one["head"]
            values = piece.column("value")
            if not pc.any(pc.match_substring(values, '"')).as_py():
                if not inside:
                    found = values.filter(pa.array(_filled(values))).to_pylist()
                    yield out(found)
                    place += len(found)
                elif held:
                    held += values.to_pylist()
                continue
            found = []
            for line in values.to_pylist():
                begins = not inside and line.strip()
                if begins or (held and inside):
                    held.append(line)
                inside = ends_inside(line, inside, delimiter)
                if not inside and held:
                    found.append("\n".join(held))
                    held = []
            yield out(found)
            place += len(found)
        if held:
            yield out(["\n".join(held)], True)

    return run


def records(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """place (of a record among all), file_row (among its file's; 0 is the header), row (among all but headers) and text."""
    splits = written(placed(survey(lines, delimiter)), "splits")
    cut = lines.join(F.broadcast(splits.select("file", "block", "inside", "first", "head", "heads")), ["file", "block"])  # a row a split
    found = cut.mapInArrow(_cut(delimiter), "place long, file_row long, row long, open boolean, text string")
    leads = splits.where("inside").select((F.col("first") - 1).alias("place"), "file", "block", "lead")
    rest = leads.groupBy("place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "lead"))), lambda s: s["lead"]), "\n").alias("rest"))
    rest = written(rest, "rest")
    size = rest.agg(F.coalesce(F.sum(F.length("rest")), F.lit(0))).first()[0]
    if not size and rest.isEmpty():
        joined = found.withColumn("rest", F.lit(None).cast("string"))
    elif size <= BROADCAST:
        joined = found.join(F.broadcast(rest), "place", "left")
    else:
        joined = found.where("not open").withColumn("rest", F.lit(None).cast("string")).unionByName(found.where("open").join(rest, "place", "left"))
    text = F.when(F.col("open"), F.concat_ws("\n", "text", "rest")).otherwise(F.col("text"))
    return joined.select("place", "file_row", "row", F.regexp_replace(text, "\r$", "").alias("text"))
