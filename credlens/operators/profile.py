"""Profiling: which column is the time, which columns are numeric, and what role every column plays.

Everything about all columns comes from aggregates over the table without a shuffle of its cells: counts, ends and sketches of
different values; then, for columns that look numeric, whether any value lies apart from both ends. Whether a time never falls is
told by the first and last value of each task's rows, put together in the rows' order. Only a row for each column reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric
from .ordered import BLOCK, each_piece, ordered

SHEET, ROW = "__sheet__", "__row__"
# Words that make a column an identifier or hint at a time.
ID_WORDS = ("序号", "编号", "代码", "编码", "行政区代码")
TIME_WORDS = ("time", "date", "timestamp", "datetime", "采集", "日期", "时间")
#: Patterns of text dates, tried on the first value of a column; that one then holds for all of it.
FORMATS = (
    (r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\.\d+", "yyyy-MM-dd[ ]['T']HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]"), (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ss"), (r"\d{4}-\d\d-\d\d \d\d:\d\d", "yyyy-MM-dd HH:mm"), (r"\d{4}-\d\d-\d\dT\d\d:\d\d", "yyyy-MM-dd'T'HH:mm"),
    (r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"), (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{4}/\d{1,2}/\d{1,2} \d\d:\d\d:\d\d", "yyyy/M/d HH:mm:ss"), (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d\d", "yyyy/M/d H:mm"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d\d", "M/d/yyyy H:mm"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{8}", "yyyyMMdd"), (r"[A-Za-z]{3} \d{1,2},? \d{4}", "MMM d[,] yyyy"),
)


def is_identifier(column: str) -> bool:
    name = column.strip().lower()
    return any(w in name for w in ID_WORDS) or name in ("id", "index") or bool({"id", "index"} & set(re.split(r"[_-]", name)))


def time_hint(column: str) -> bool:
    return any(w in column.lower() for w in TIME_WORDS)


def time_format(first: str | None) -> str | None:
    return next((f for p, f in FORMATS if first is not None and re.fullmatch(p, first.strip())), None)


def parse_time(column: Column, kind: str, form: str | None = None) -> Column:
    """A column of that type as a time stamp. Numbers are nanoseconds since 1970; texts follow one format."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return column.cast("timestamp")
    if kind == "string":
        return F.try_to_timestamp(F.trim(column), F.lit(form)) if form else F.lit(None).cast("timestamp")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.when(F.abs(column.cast("double")) < 9.2e18, F.timestamp_micros(F.floor(column.cast("double") / 1000).cast("long")))
    return F.lit(None).cast("timestamp")


@dataclass(frozen=True)
class ColumnStats:
    """What the aggregates say of a column."""

    column: str
    kind: str
    rows: int
    present: int
    numeric: int
    times: int
    plausible: int
    distinct: int
    increasing: bool = False
    form: str | None = None

    @property
    def numeric_rate(self) -> float:
        return self.numeric / max(self.rows, 1)

    @property
    def time_rate(self) -> float:
        return 0.0 if self.numeric_rate >= 0.8 and not time_hint(self.column) else self.times / max(self.rows, 1)


@dataclass(frozen=True)
class Profile:
    time: str | None
    numeric: list[str]
    rows: int
    columns: int
    missing_rate: float
    stats: list[ColumnStats] = field(default_factory=list)

    @property
    def form(self) -> str | None:
        return next((s.form for s in self.stats if s.column == self.time), None)


def least_valid(rows: int, share: float) -> int:
    return min(max(8, int(rows * share)), 30)


#: Relative error of the counts of different values that aren't exact.
ABOUT = 0.02


def column_stats(df: DataFrame, block: int = BLOCK, exact: bool = False) -> list[ColumnStats]:
    """exact: different values are counted, by a shuffle of all cells; else numbers from 3 on are estimates."""
    kinds = {c: k for c, k in df.dtypes if c != ROW}
    texts = [c for c, k in kinds.items() if k == "string"]
    firsts = df.agg(F.count("*").alias("_n"), *[F.first(F.nullif(F.trim(f"`{c}`"), F.lit("")), ignorenulls=True).alias(f"f{k}") for k, c in enumerate(texts)]).first()
    forms = {c: time_format(firsts[f"f{k}"]) for k, c in enumerate(texts)}
    times = {c: parse_time(F.col(f"`{c}`"), k, forms.get(c)) for c, k in kinds.items()}
    counts = []
    for i, (c, k) in enumerate(kinds.items()):
        year = F.year(times[c])
        counts += [F.count(f"`{c}`").alias(f"p{i}"), F.count(numeric(F.col(f"`{c}`"), k)).alias(f"n{i}"), F.count(times[c]).alias(f"t{i}"), F.count_if((year >= 1990) & (year <= 2100)).alias(f"y{i}")]
        if orderable(k):
            counts += [F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"b{i}")] if numeric_type(k) else []
            counts += [] if exact else [F.approx_count_distinct(F.col(f"`{c}`"), ABOUT).alias(f"d{i}")]
    row = df.agg(*counts).first()
    if exact:
        distinct = exact_counts(df, [c for c, k in kinds.items() if orderable(k)])
    else:
        distinct = {c: row[f"d{i}"] for i, (c, k) in enumerate(kinds.items()) if orderable(k)}
        likely = {c: i for i, c in enumerate(kinds) if c in distinct and row[f"n{i}"] >= 0.7 * firsts["_n"] > 0}
        distinct |= {c: max(3, distinct[c]) if n > 2 else n for c, n in few_values(df, likely, {c: (row[f"a{i}"], row[f"b{i}"]) for c, i in likely.items() if numeric_type(kinds[c])}).items()}
    out = [ColumnStats(c, k, firsts["_n"], row[f"p{i}"], row[f"n{i}"], row[f"t{i}"], row[f"y{i}"], distinct.get(c, 0), form=forms.get(c)) for i, (c, k) in enumerate(kinds.items())]
    candidates = [s.column for s in out if is_candidate(s)]
    if candidates:
        rising = never_falls(df.select(*[F.unix_micros(times[c]).alias(c) for c in candidates], *([ROW] if ROW in df.columns else [F.monotonically_increasing_id().alias(ROW)])), candidates, block)
        out = [ColumnStats(**(s.__dict__ | {"increasing": rising.get(s.column, False)})) for s in out]
    return out


def orderable(kind: str) -> bool:
    return not kind.startswith(("map", "variant")) and "map<" not in kind


def numeric_type(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def exact_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many different values each column has."""
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    long = df.select(F.explode(values).alias("p")).select("p.*").where("v is not null")
    return dict(tuple(r) for r in long.groupBy("c", "v").agg(F.lit(1).alias("one")).groupBy("c").count().collect())


def few_values(df: DataFrame, columns: Sequence[str], ends: dict[str, tuple]) -> dict[str, int]:
    """0, 1 or 2, if a column has as many different values, else 3. ends: least and largest value of columns where they are known."""
    if texts := [c for c in columns if c not in ends]:
        found = df.agg(*[f(f"`{c}`").alias(f"{n}{k}") for k, c in enumerate(texts) for n, f in (("a", F.min), ("b", F.max))]).first()
        ends = ends | {c: (found[f"a{k}"], found[f"b{k}"]) for k, c in enumerate(texts)}
    out = {c: 0 if lo is None else 1 if lo == hi else 2 for c, (lo, hi) in ends.items()}
    if open_ := [c for c, n in out.items() if n == 2]:
        apart = df.agg(*[F.bool_or((F.col(f"`{c}`") != F.lit(ends[c][0])) & (F.col(f"`{c}`") != F.lit(ends[c][1]))).alias(f"m{k}") for k, c in enumerate(open_)]).first()
        out |= {c: 3 for k, c in enumerate(open_) if apart[f"m{k}"]}
    return out


def never_falls(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> dict[str, bool]:
    """Whether each column never falls, in row order and without its gaps. Each task says of its rows how they begin and end and
    whether they fall; where tasks' rows follow one another, that is enough. Rows in any other order are put in order."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}  # first row, last row, first value, last value, rises, in order
        for batch in batches:
            row = np.asarray(batch.column(ROW))
            for k, c in enumerate(names):
                there = np.asarray(batch.column(c).is_valid())
                if there.any():
                    x, at = np.asarray(batch.column(c).drop_null()), row[there]
                    new = [int(at[0]), int(at[-1]), int(x[0]), int(x[-1]), bool((x[1:] >= x[:-1]).all()), bool((at[1:] > at[:-1]).all())]
                    old = seen.get(k)
                    seen[k] = new if old is None else [old[0], new[1], old[2], new[3], old[4] and new[4] and old[3] <= new[2], old[5] and new[5] and old[1] < new[0]]
        if seen:
            yield pa.RecordBatch.from_pylist([dict(zip(("k", "r0", "r1", "x0", "x1", "rises", "sorted"), (k, *v), strict=True)) for k, v in seen.items()])

    pieces = df.mapInArrow(run, "k long, r0 long, r1 long, x0 long, x1 long, rises boolean, sorted boolean")
    before = Window.partitionBy("k").orderBy("r0")  # a row a task
    follows, higher = F.coalesce(F.lag("r1").over(before) < F.col("r0"), F.lit(True)), F.coalesce(F.lag("x1").over(before) <= F.col("x0"), F.lit(True))
    whole = pieces.select("k", (F.col("sorted") & follows).alias("sorted"), (F.col("rises") & higher).alias("rises"))
    found = {names[r["k"]]: r for r in whole.groupBy("k").agg(F.bool_and("sorted").alias("sorted"), F.bool_and("rises").alias("rises")).collect()}
    rest = [c for c in names if c in found and not found[c]["sorted"]]
    return {c: found[c]["rises"] for c in names if c in found} | (increasing(df, rest, block) if rest else {})


def increasing(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> dict[str, bool]:
    """Whether each column never falls, in row order and without its gaps."""
    series = ordered(df, columns, [ROW], block)
    pieces = each_piece(series, "series string, at long, falls boolean", lambda p: {"falls": bool((np.diff(p.since) < 0).any())})
    found = pieces.groupBy("series").agg(F.bool_or("falls").alias("falls"))
    return {r["series"]: not r["falls"] for r in found.collect()}  # a row a column


def is_candidate(s: ColumnStats) -> bool:
    """Whether a column may be the time, but for its rank among others."""
    if s.column == SHEET or not s.rows or (s.numeric_rate >= 0.8 and not time_hint(s.column)):
        return False
    if not time_hint(s.column) and s.plausible < 0.8 * max(s.times, 1):
        return False
    return s.times / s.rows >= 0.6 and s.times >= least_valid(s.rows, 0.05)


def detect_time(stats: Sequence[ColumnStats]) -> str | None:
    """The candidate with the highest score; ties go to the leftmost."""
    score = lambda s: s.times / s.rows + 0.25 * s.increasing + 0.2 * time_hint(s.column)
    return max((s for s in stats if is_candidate(s)), key=score, default=None).column if any(map(is_candidate, stats)) else None


def detect_numeric(stats: Sequence[ColumnStats], time: str | None) -> list[str]:
    return [s.column for s in stats if s.column not in (time, SHEET) and not is_identifier(s.column) and s.numeric_rate >= 0.7 and s.numeric >= least_valid(s.rows, 0.08) and s.distinct >= 3]


def profile(df: DataFrame, block: int = BLOCK, exact: bool = False) -> Profile:
    """exact: different values of all columns are counted one by one (column_stats)."""
    stats = column_stats(df, block, exact)
    time = detect_time(stats)
    wanted = detect_numeric(stats, time)
    live = [s for s in stats if s.present and s.column != SHEET]
    valid = lambda s: s.times if s.column == time else s.numeric if s.column in wanted else s.present
    rows = stats[0].rows if stats else 0
    missing = 1 - sum(map(valid, live)) / (rows * len(live)) if rows and live else 0.0
    return Profile(time, wanted, rows, len(stats), missing, stats)


def prepare(df: DataFrame, found: Profile) -> DataFrame:
    """The table with its time and numeric columns parsed; rows aren't moved, series are ordered when they are used."""
    kinds = dict(df.dtypes)
    parsed = {c: numeric(F.col(f"`{c}`"), kinds[c]) for c in found.numeric}
    if found.time:
        parsed[found.time] = parse_time(F.col(f"`{found.time}`"), kinds[found.time], found.form)
    return df.withColumns(parsed)


def preview(df: DataFrame, found: Profile, keys: Sequence[str] = (), n: int = 30) -> DataFrame:
    """The first rows in time order."""
    order = [F.col(f"`{c}`").asc_nulls_last() for c in ([found.time] if found.time else [])] + [F.col(f"`{c}`") for c in keys]
    return prepare(df, found).orderBy(*order).limit(n) if order else prepare(df, found).limit(n)


ROLES = {
    "empty": "The column is empty and is not scored.",
    "sheet": "The column names the sheet a row comes from; it is not scored.",
    "identifier": "The column looks like a number or code that marks rows; it is not scored.",
    "time": "The column orders the rows; values that can't be parsed come last.",
    "numeric": "The column is scored; missing values are left out by each check.",
    "too few values": "The column is numeric, but has too few valid values to be scored.",
    "too little variation": "The column is numeric, but has fewer than three different values.",
    "other time": "The column holds times, but is not the main time column.",
    "text": "Most values are not numbers; texts and categories are not scored.",
    "not included": "The column doesn't meet the conditions for a numeric column.",
}
SCREENING = "column string, raw_dtype string, role string, entered_analysis boolean, non_null_count long, missing_rate double, unique_count long, numeric_valid_rate double, datetime_valid_rate double, handling string"


def role(s: ColumnStats, found: Profile) -> str:
    numeric_like = s.numeric_rate >= 0.8
    date_like = s.time_rate >= 0.6 and s.plausible >= 0.8 * max(s.times, 1) and (time_hint(s.column) or not numeric_like)
    if not s.present:
        return "empty"
    if s.column == SHEET:
        return "sheet"
    if is_identifier(s.column):
        return "identifier"
    if s.column == found.time:
        return "time"
    if s.column in found.numeric:
        return "numeric"
    if s.numeric_rate >= 0.7:
        if s.numeric < least_valid(s.rows, 0.08):
            return "too few values"
        if s.distinct < 3:
            return "too little variation"
    return "other time" if date_like else "text" if s.numeric_rate < 0.7 else "not included"


def screening(df: DataFrame, found: Profile) -> DataFrame:
    """A row for each column with its role and how it is handled."""
    rows = []
    for s in found.stats:
        r, missing = role(s, found), 1 - s.present / max(s.rows, 1)
        more = " More than 30 % of the values are missing: read its scores with care." if r == "numeric" and missing > 0.3 else ""
        rows.append((s.column, s.kind, r, r == "numeric", s.present, missing, s.distinct, s.numeric_rate, s.time_rate, ROLES[r] + more))
    return df.sparkSession.createDataFrame(rows, SCREENING)


def screening_table(records: DataFrame) -> DataFrame:
    """The screening for display, with percentages as text."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100).alias(c)
    return records.select("column", "role", "entered_analysis", "non_null_count", percent("missing_rate"), "unique_count", percent("numeric_valid_rate"), percent("datetime_valid_rate"), "handling")
