from __future__ import annotations

import csv
import io
import random

import pytest

from credlens.operators.profile import ROW
from credlens.sources.readers import MISSING, header_names, read, read_bytes
from credlens.sources.records import ends_inside, lines_of, placed, records, survey


def random_csv(seed, rows, end="\n"):
    """A file's text and its records: quoted line breaks, commas, doubled quotes, stray quotes, blank lines."""
    r = random.Random(seed)
    out, found = io.StringIO(), []
    write = csv.writer(out, lineterminator=end)
    write.writerow(["a", "b c", "d"])
    for k in range(rows):
        row = [str(k), "".join(r.choice(['x', 'y,', '"', "\n", " ", "é"]) for _ in range(r.choice([0, 1, 3, 30]))), r.choice(["NA", "plain", "5 3", "long\n\ntext " * r.choice([1, 1, 80])])]
        write.writerow(row)
        found.append(row)
        if r.random() < 0.1:
            out.write(end)
    return out.getvalue(), found


def plain(rows):
    return [[None if v in MISSING else v for v in row] for row in rows]


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_splits_give_the_same_rows_as_one_reader(spark, tmp_path, seed, end):
    texts = [random_csv(10 * seed + k, 150, end) for k in range(2)]
    for k, (text, _) in enumerate(texts):
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    want = plain([row for _, rows in texts for row in rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "2000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read(spark, f"{tmp_path}/*.csv").df
            if size == "300":
                splits = placed(survey(lines_of(spark, f"{tmp_path}/*.csv"))).collect()
                assert len(splits) > 40 and any(s["inside"] for s in splits) and any(s["inside"] and s["end1"] and not s["starts"] for s in splits)
            got = df.orderBy(ROW).collect()
            assert [r[ROW] for r in got] == list(range(len(want)))
            assert [[r["a"], r["b c"], r["d"]] for r in got] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_uploads(spark):
    text, rows = random_csv(77, 60)
    got = read_bytes(spark, ("﻿" + text).encode(), "t.CSV").df.orderBy(ROW).collect()
    assert [[r["a"], r["b c"], r["d"]] for r in got] == plain(rows)
    with pytest.raises(ValueError):
        read_bytes(spark, b"", "t.txt")


def test_states_of_lines():
    for line, outside, inside in (("a,b", False, True), ('a,"b', True, False), ('"a""b",c', False, False), ('x"y,z', False, False), ('5" pipe,"open', True, True), ('""', False, True), ('"', True, False)):
        assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside), line
    assert header_names('a,"b\nc",,A') == ["a0", "b\nc", "_c2", "A3"]


def test_files_without_quotes_or_records(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,2\n\n3,NA\n")
    assert [(r["a"], r["b"], r[ROW]) for r in read(spark, str(tmp_path / "p.csv")).df.orderBy(ROW).collect()] == [("1", "2", 0), ("3", None, 1)]
    (tmp_path / "h.csv").write_text('"a","b"\n')
    df = read(spark, str(tmp_path / "h.csv")).df
    assert df.columns == ["a", "b", ROW] and df.count() == 0
    (tmp_path / "e.csv").write_text(' \n\n"')
    assert records(lines_of(spark, str(tmp_path / "e.csv"))).count() == 1
