"""Workbooks: the sheets of .xlsx files as DataFrames, and how they go together.

A sheet is one partition of a Python data source: its task reads that sheet's part of the file as a stream, and hands over Arrow
batches. A first pass over the sheets, in tasks too, finds each one's header, used columns and their types; the driver sees
only these. Files in stores that Python can't open come through Spark's binary files instead, a task for each sheet as well.
"""

from __future__ import annotations

import base64
import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from itertools import combinations
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.profile import ROW, SHEET

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Sheets are merged if their columns overlap this much on average and at least.
AVERAGE, LEAST = 0.75, 0.55
#: Rows of an Arrow batch.
BATCH = 8192
# Numbers of the built-in date formats.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


@dataclass
class Workbook:
    df: DataFrame
    strategy: str = "single"
    sheets: dict[str, DataFrame] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    @staticmethod
    def of(df: DataFrame) -> Workbook:
        return Workbook(df)


def clean_label(value: object) -> str:
    """A header cell without any white space; names made up for empty cells are empty."""
    text = re.sub(r"\s+", "", "" if value is None else str(value))
    return "" if re.match(r"(?i)unnamed:", text) else text


def unique_columns(labels: Sequence[str]) -> list[str]:
    """Blank labels get their position as name, repeated ones a number."""
    out: list[str] = []
    for k, label in enumerate(labels, 1):
        name, n = label or f"column_{k}", 1
        while (name if n == 1 else f"{name}_{n}") in out:
            n += 1
        out.append(name if n == 1 else f"{name}_{n}")
    return out


def is_number(value: object) -> bool:
    try:
        return value is not None and not isinstance(value, datetime) and float(str(value)) == float(str(value))
    except ValueError:
        return False


def looks_like_header(row: Sequence[object]) -> bool:
    """Whether a second row is a header as well: three cells or more, and less than a quarter of all numbers."""
    return sum(clean_label(v) != "" for v in row) >= 3 and sum(map(is_number, row)) / max(len(row), 1) < 0.25


@dataclass
class Layout:
    """Where a sheet's values are: names, positions and types of its columns, and how many of its rows that aren't empty are headers."""

    names: list[str]
    positions: list[int]
    kinds: list[str]
    headers: int
    rows: int


class Outline:
    """What a sheet's rows, one after another, say about its layout. Only the first two rows are kept."""

    def __init__(self) -> None:
        self.first: list[list[object]] = []
        self.kinds: dict[int, str] = {}  # of the third row on
        self.rows = 0

    @staticmethod
    def note(kinds: dict[int, str], row: Sequence[object]) -> None:
        for k, v in enumerate(row):
            if v not in (None, ""):
                kind = "double" if isinstance(v, float) else "timestamp" if isinstance(v, datetime) else "string"
                kinds[k] = kind if kinds.get(k, kind) == kind else "string"

    def add(self, row: Sequence[object]) -> None:
        if all(v in (None, "") for v in row):
            return
        self.rows += 1
        if len(self.first) < 2:
            self.first.append(list(row))
        else:
            self.note(self.kinds, row)

    def layout(self) -> Layout:
        """Columns without any value go; one or two rows are headers."""
        if not self.rows:
            return Layout([], [], [], 0, 0)
        seen = dict(self.kinds)
        for row in self.first:
            self.note(seen, row)
        used = sorted(seen)
        cell = lambda row, k: row[k] if k < len(row) else None
        top, *rest = [[cell(row, k) for k in used] for row in self.first]
        head, headers, kinds = [clean_label(v) for v in top], 1, dict(self.kinds)
        if rest and looks_like_header(rest[0]):
            upper = head[:]
            for k in range(1, len(upper)):
                upper[k] = upper[k] or upper[k - 1]
            lower = [clean_label(v) for v in rest[0]]
            head, headers = [f"{u}-{low}" if u and low and u != low else u or low for u, low in zip(upper, lower, strict=True)], 2
        elif rest:
            self.note(kinds, self.first[1])
        columns = [(n, k, kinds[k]) for n, k in zip(unique_columns(head), used, strict=True) if k in kinds]
        return Layout(*map(list, zip(*columns, strict=True)), headers, self.rows - headers) if columns else Layout([], [], [], headers, 0)


def parse_sheet(rows: Sequence[Sequence[object]]) -> tuple[list[str], list[list[object]]]:
    """Column names and rows of a small sheet: empty rows and columns go, one or two rows are headers."""
    outline = Outline()
    for row in rows:
        outline.add(row)
    found = outline.layout()
    filled = [list(r) for r in rows if any(v not in (None, "") for v in r)][found.headers :]
    return found.names, [[r[k] if k < len(r) else None for k in found.positions] for r in filled] if found.names else []


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def sheet_strategy(columns: Sequence[set[str]]) -> str:
    """single, merged or separate, by how much the sheets' columns overlap."""
    if len(columns) <= 1:
        return "single"
    overlaps = [jaccard(a, b) for a, b in combinations(columns, 2)]
    return "merged" if sum(overlaps) / len(overlaps) >= AVERAGE and min(overlaps) >= LEAST else "separate"


def opened(path: str) -> io.BufferedIOBase | pa.NativeFile:
    """A file for reading at any place, so that only the parts needed are read. OSError or ValueError if Python can't."""
    if path.startswith("file:") or "://" not in path:
        return open(unquote(urlparse(path).path) if path.startswith("file:") else path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind as they are read; each is gone when the next one comes."""
    if name not in book.namelist():
        return
    parents: list[ElementTree.Element] = []
    with book.open(name) as stream:
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == MAIN + tag:
                yield element
                parents[-1].clear()


def sheet_targets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Each sheet's name and the part of the file that holds it."""
    read = lambda name: ElementTree.fromstring(book.read(name))
    targets = {r.get("Id"): r.get("Target").lstrip("/") for r in read("xl/_rels/workbook.xml.rels")}
    found = [(s.get("name"), targets[s.get(REL)]) for s in read("xl/workbook.xml").iter(f"{MAIN}sheet")]
    return [(name, t if t.startswith("xl/") else f"xl/{t}") for name, t in found]


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles, out = ElementTree.fromstring(book.read("xl/styles.xml")), set()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iterfind(f"{MAIN}numFmts/{MAIN}numFmt")}
    for k, x in enumerate(styles.iterfind(f"{MAIN}cellXfs/{MAIN}xf")):
        code = int(x.get("numFmtId", 0))
        if code in DATE_FORMATS or re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(code, "")), re.I):
            out.add(k)
    return out


def sheet_rows(book: zipfile.ZipFile, target: str) -> Iterator[list[object]]:
    """A sheet's rows as they are read; numbers in date formats become time stamps. The texts that sheets share are held."""
    strings = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in _elements(book, "xl/sharedStrings.xml", "si")]
    dates = date_styles(book)
    for row in _elements(book, target, "row"):
        values: list[object] = []
        for cell in row.iterfind(f"{MAIN}c"):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = reduce(lambda n, c: n * 26 + ord(c) - 64, letters[0], 0) - 1 if letters else len(values)
            values += [None] * (at + 1 - len(values))
            values[at] = _value(cell, strings, dates)
        yield values


def _value(cell: ElementTree.Element, strings: list[str], dates: set[int]) -> object:
    kind, text = cell.get("t"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(text)]
    if kind in ("str", "d"):
        return text
    if kind == "b":
        return text == "1"
    if int(cell.get("s", -1)) in dates:
        return datetime(1899, 12, 30) + timedelta(days=float(text))
    return float(text)


def _cell(value: object, kind: str, zone: ZoneInfo) -> object:
    if value in (None, ""):
        return None
    if kind == "timestamp":
        return value.replace(tzinfo=zone)
    if kind == "string":
        return value.strftime("%Y-%m-%d %H:%M:%S") if isinstance(value, datetime) else f"{value:.15g}" if isinstance(value, float) else str(value)
    return value


ARROW = {"double": pa.float64(), "timestamp": pa.timestamp("us", "UTC"), "string": pa.string(), "bigint": pa.int64()}


def sheet_batches(book: zipfile.ZipFile, part: dict, fields: list[tuple[str, str]], zone: str) -> Iterator[pa.RecordBatch]:
    """A sheet's rows as batches of the fields (name and type) asked for; columns that it lacks are null."""
    layout = Layout(**part["layout"])
    at, tz, held, seen = dict(zip(layout.names, layout.positions, strict=True)), ZoneInfo(zone), [], 0

    def batch(first: int) -> pa.RecordBatch:
        columns = {}
        for name, kind in fields:
            k = at.get(name)
            if name == ROW:
                values = [part["offset"] + first + i for i in range(len(held))]
            elif name == SHEET:
                values = [part["name"]] * len(held)
            else:
                values = [None if k is None or k >= len(r) else _cell(r[k], kind, tz) for r in held]
            columns[name] = pa.array(values, ARROW[kind])
        return pa.RecordBatch.from_pydict(columns)

    for row in sheet_rows(book, part["target"]):
        if any(v not in (None, "") for v in row):
            seen += 1
            if seen > layout.headers:
                held.append(row)
        if len(held) == BATCH:
            yield batch(seen - layout.headers - len(held))
            held.clear()
    if held:
        yield batch(seen - layout.headers - len(held))


def _outlines(book: zipfile.ZipFile, part: dict) -> Iterator[pa.RecordBatch]:
    """part with each sheet's name, target and layout, a row for each sheet that is asked for."""
    for name, target in [(part["name"], part["target"])] if "target" in part else sheet_targets(book):
        if part.get("names"):
            found = part | {"name": name, "target": target}
        else:
            outline = Outline()
            for row in sheet_rows(book, target):
                outline.add(row)
            found = part | {"name": name, "target": target, "layout": outline.layout().__dict__}
        yield pa.RecordBatch.from_pydict({"part": [json.dumps(found)]})


class SheetSource(DataSource):
    """Options: parts (a JSON list: file, and sheet, of each partition), fields (JSON: names and types; none to get outlines),
    zone, and content (base64) in place of a file."""

    @classmethod
    def name(cls) -> str:
        return "credlens_sheets"

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options))


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.parts, self.fields, self.zone = json.loads(options["parts"]), json.loads(options["fields"]), options["zone"]
        self.content = options.get("content")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part = partition.value
        with io.BytesIO(base64.b64decode(self.content)) if self.content else opened(part["file"]) as file, zipfile.ZipFile(file) as book:
            yield from sheet_batches(book, part, self.fields, self.zone) if self.fields else _outlines(book, part)


def _load(spark: SparkSession, parts: list[dict], fields: list[tuple[str, str]], content: bytes | None, direct: bool) -> DataFrame:
    """The parts (sheets) with the fields asked for, a partition each; their outlines if none is asked for."""
    schema = ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in fields) or "part string"
    zone = spark.conf.get("spark.sql.session.timeZone")
    if direct:
        spark.dataSource.register(SheetSource)
        options = {"parts": json.dumps(parts), "fields": json.dumps(fields), "zone": zone} | ({"content": base64.b64encode(content).decode()} if content is not None else {})
        return spark.read.format("credlens_sheets").schema(schema).options(**options).load()

    def reading(part: dict):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in (x for b in batches for x in b.column("content")):
                with zipfile.ZipFile(pa.BufferReader(held.as_buffer())) as book:
                    yield from sheet_batches(book, part, fields, zone) if fields else _outlines(book, part)

        return run

    frames = [spark.read.format("binaryFile").load(p["file"]).select("content").mapInArrow(reading(p), schema) for p in parts]
    return reduce(lambda a, b: a.unionAll(b), frames)


def read_xlsx(spark: SparkSession, source: str | bytes, direct: bool | None = None) -> Workbook:
    """All sheets with values, merged by name if their columns agree, else kept apart (df then holds all rows too). A path may
    name a folder: its files' sheets go together, their names after their files'. direct: whether tasks open the files (by
    default if the driver can open the first)."""
    content = source if isinstance(source, bytes) else None
    if content is None:
        files = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(source).select("path").collect() if "/~$" not in r["path"])
        if not files:
            raise ValueError(f"there is no workbook in {source}")
        if direct is None:
            try:
                opened(files[0]).close()
                direct = True
            except (OSError, ValueError, ImportError):
                direct = False
    else:
        files, direct = [""], True
    told = lambda parts: [json.loads(r["part"]) for r in _load(spark, parts, [], content, direct).collect()]  # noqa: E731  a row a sheet
    parts = [p | {"names": False} for p in told([{"file": f, "names": True} for f in files])] if files else []
    parts = told(parts) if parts else []
    if len(files) > 1:
        parts = [p | {"name": f"{unquote(p['file'].rsplit('/', 1)[-1])} / {p['name']}"} for p in parts]
    sheets, skipped, held, kinds = {}, [], [], {}
    for p in parts:
        layout = Layout(**p["layout"])
        if not layout.rows:
            skipped.append(p["name"])
            continue
        fields = list(zip(layout.names, layout.kinds, strict=True))
        sheets[p["name"]] = _load(spark, [p | {"offset": 0}], [(ROW, "bigint"), *fields], content, direct)
        held.append(p | {"offset": len(held) << 40})
        for n, k in fields:  # columns whose types differ between sheets become text
            kinds[n] = k if kinds.get(n, k) == k else "string"
    if not sheets:
        raise ValueError("no sheet of the workbook has any values")
    strategy = sheet_strategy([set(p["layout"]["names"]) for p in held])
    every = _load(spark, held, [(SHEET, "string"), (ROW, "bigint"), *kinds.items()], content, direct)
    return Workbook(every, strategy, sheets, skipped)
