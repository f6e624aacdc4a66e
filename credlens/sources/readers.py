"""Tables from CSV, Parquet, JSON and Excel files."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.profile import ROW
from .records import lines_in, lines_of, records
from .workbook import Workbook, read_xlsx

# Texts that stand for a missing value in a CSV file.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def with_rows(df: DataFrame) -> DataFrame:
    """df with the row's place: ids increase with files' parts and rows in them, without a sort."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with a header, every column text, missing values null, and rows in the order of the file. Quoted values may
    hold line breaks; splits are read in parallel all the same (`records`). multi_line: False takes every line as a record; True
    has one task read a file."""
    if multi_line is None and not lines_of(spark, path).where(F.col("value").contains('"')).isEmpty():
        return from_records(records(lines_of(spark, path)))
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", bool(multi_line)).option("escape", '"').csv(path)
    numbered = df.select("*", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return numbered.select(*cleaned(df.columns), F.struct("_p", "_b", "_m").alias("_at")).transform(_placed)


def cleaned(columns: list[str]) -> list[Column]:
    return [F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in columns]


def header_names(header: str) -> list[str]:
    """Column names from a header record: empty ones get their place, repeated ones (in any case) their place after the name."""
    names = next(csv.reader([header]), [])
    lower = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if lower.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def from_records(found: DataFrame) -> DataFrame:
    """Columns of text from CSV records, whose first, in each file, is the header."""
    first = found.where("place = 0").first()
    if first is None:
        return found.sparkSession.createDataFrame([], f"`{ROW}` long")
    names = header_names(first["text"].removeprefix("\ufeff"))
    parsed = F.from_csv("text", F.lit(", ".join(f"`{n.replace('`', '``')}` string" for n in names)), {"escape": '"', "maxCharsPerColumn": "-1"})
    rows = found.where("file_row > 0").select(F.col("row").alias(ROW), parsed.alias("r")).select(ROW, "r.*")
    return rows.select(*cleaned(names), ROW)


def read_csv_bytes(spark: SparkSession, content: bytes) -> DataFrame:
    """The same of an uploaded file's bytes (UTF-8)."""
    return from_records(records(lines_in(spark, content.decode("utf-8"))))


def _placed(df: DataFrame) -> DataFrame:
    """Splits are few: their order is found from one row a split, and a row's place is its id moved to its split's turn."""
    splits = df.groupBy("_at._p", "_at._b").agg(F.min("_at._m").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_p", "_b"))
    splits = splits.select(F.col("_p").alias("_sp"), F.col("_b").alias("_sb"), "_first", (upto - F.col("_n")).alias("_offset"))
    joined = df.join(F.broadcast(splits), (F.col("_at._p") == F.col("_sp")) & (F.col("_at._b") == F.col("_sb")))
    return joined.withColumn(ROW, F.col("_offset") + F.col("_at._m") - F.col("_first")).drop("_at", "_sp", "_sb", "_first", "_offset")


def read(spark: SparkSession, path: str) -> Workbook:
    """A file by its suffix: .csv, .parquet, .json, .xlsx."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return Workbook.of(read_csv(spark, path))
    if suffix == "parquet":
        return Workbook.of(with_rows(spark.read.parquet(path)))
    if suffix in ("json", "jsonl", "ndjson"):
        return Workbook.of(with_rows(spark.read.json(path)))
    if suffix == "xlsx":
        return read_xlsx(spark, path)
    if suffix == "xls":
        raise ValueError("the old .xls format can't be read: save the file as .xlsx")
    raise ValueError(f"files of type .{suffix} can't be read; use .csv, .parquet, .json or .xlsx")


def read_bytes(spark: SparkSession, content: bytes, name: str) -> Workbook:
    """An uploaded file, by its name's suffix: .csv or .xlsx."""
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return Workbook.of(read_csv_bytes(spark, content))
    if suffix == "xlsx":
        return read_xlsx(spark, content)
    raise ValueError(f"uploads of type .{suffix} can't be read; use .csv or .xlsx")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
