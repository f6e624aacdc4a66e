from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credlens.functions import ramp_down, ramp_up
from credlens.operators import profile
from credlens.operators.ordered import ordered
from credlens.plans import config, report, scoring
from credlens.plans.analysis import analyze, analyze_file, analyze_workbook
from credlens.sources import read, read_xlsx
from credlens.sources.samples import KINDS, sample
from credlens.sources.workbook import clean_label, looks_like_header, parse_sheet, sheet_strategy, unique_columns
from credlens.streaming.windows import windowed_checks

from .books import xlsx


def at(k):
    return f"2024-11-{5 + k // 96:02d} {k % 96 // 4:02d}:{k % 4 * 15:02d}"


def natural(n=56, seed=1):
    r = random.Random(seed)
    return [(at(k), 7 + r.gauss(0, 0.4), 900 + r.gauss(0, 120), 4 + r.gauss(0, 0.7)) for k in range(n)]


def drawn(n=56):
    return [(at(k), 9 - k / 16, 500 + 7.0 * k, 2 + k / 32) for k in range(n)]


SCHEMA = "logged_time string, well_ph double, lamp_light double, tank_ec double"


def test_natural_scores_above_drawn(spark):
    good, bad = (analyze(spark.createDataFrame(rows, SCHEMA), indicators=list(config.ALL)) for rows in (natural(), drawn()))
    assert good.profile.time == "logged_time" and good.profile.numeric == ["well_ph", "lamp_light", "tank_ec"]
    assert good.total["total_score"] > bad.total["total_score"]
    assert bad.sub_scores["correlation"] == pytest.approx(33, abs=0.5) and bad.sub_scores["sampling"] == 100
    text = json.loads(report.to_json(bad))
    assert text["ok"] and len(text["preview"]) == 30 and len(text["reasons"]) <= 13
    assert "<script" not in report.to_html(bad, "<script>")


def test_samples(spark):
    found = {k: analyze(sample(spark, k)) for k in KINDS}
    assert found["real"].profile.time == "read_at" and len(found["real"].profile.numeric) == 4
    assert found["real"].total["total_score"] > found["fake"].total["total_score"]
    with pytest.raises(ValueError):
        sample(spark, "other")


def test_change_point_chart(spark):
    df = spark.createDataFrame([(k, 0.0 if k < 30 else 10.0, 1.0) for k in range(60)], "i long, step double, flat double")
    rows = report.changepoint_chart(ordered(df, ["step", "flat"], ["i"]), points=20).collect()
    assert [r["at"] for r in rows if r["series"] == "step" and r["mark"]] in ([9], [10]) and sum(r["series"] == "step" for r in rows) == 20
    assert [r["at"] for r in rows if r["series"] == "flat" and r["mark"]] == [0] and sum(r["series"] == "flat" for r in rows) == 20  # its CUSUM is 0 from the start


def test_no_numeric_column(spark):
    a = analyze(spark.createDataFrame([("x",), ("y",)], "name string"))
    assert not a.ok and json.loads(report.to_json(a))["ok"] is False


def test_empty_table(spark):
    a = analyze(spark.createDataFrame([], "t timestamp, v double"))
    assert not a.ok and a.profile.missing_rate == 0


def test_csv_keeps_row_order_and_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("when,v,w\n" + "\n".join(f"2026-01-01 00:{k:02d},{'NA' if k == 5 else 50 - k},{k}d" for k in range(40)))
    df = read(spark, str(path)).df
    assert [r["v"] for r in df.orderBy(profile.ROW).limit(7).collect()] == ["50", "49", "48", "47", "46", None, "44"]
    found = profile.profile(df)
    assert found.time == "when" and found.numeric == ["v"]


def test_unknown_suffix(spark):
    for name in ("a.xls", "a.txt"):
        with pytest.raises(ValueError):
            read(spark, name)


def test_roles(spark):
    n = 40
    rows = [(None, k, f"2026-01-{1 + k % 28:02d}", f"2026-02-{1 + k % 28:02d}", float(k % 2), float(k) if k < 5 else None, "abc", k / 3, "S") for k in range(n)]
    df = spark.createDataFrame(rows, "void string, row_id int, date string, other_date string, two double, few double, text string, v double, __sheet__ string")
    found = profile.profile(df)
    roles = {r["column"]: r["role"] for r in profile.screening(df, found).collect()}
    assert roles == {"void": "empty", "row_id": "identifier", "date": "time", "other_date": "other time", "two": "too little variation", "few": "text", "text": "text", "v": "numeric", "__sheet__": "sheet"}


def test_identifiers():
    assert [profile.is_identifier(c) for c in ("id", "row_index", "a-id-b", "idle", "l_orderkey", "event_id", "编号")] == [True, True, True, False, False, True, True]


def test_hinted_integer_is_the_time(spark):
    df = spark.createDataFrame([(k, float(k * k % 17)) for k in range(30)], "update_count long, v double")
    assert profile.profile(df).time == "update_count"


def test_one_date_format_for_a_column(spark):
    df = spark.createDataFrame([("2026-04-01 06:00",), ("2026/04/01 07:00",)], "t string").select(profile.parse_time(F.col("t"), "string", profile.time_format("2026-04-01 06:00")).alias("t"))
    assert [r["t"] is None for r in df.collect()] == [False, True]


def test_ramps(spark):
    row = spark.range(1).select(ramp_up(F.lit(None).cast("double"), 0, 1, 5).alias("a"), ramp_up(F.lit(float("nan")), 0, 1, 5).alias("b"), ramp_down(F.lit(0.5), 1, 0, 10).alias("c"), ramp_up(F.lit(0.25), 0.5, 1, 10).alias("d")).first()
    assert tuple(row) == (5, 5, 5, 0)


def test_sheet_parts():
    assert clean_label(" a b\n") == "ab" and clean_label("Unnamed: 3") == ""
    assert unique_columns(["a", "", "a", "a"]) == ["a", "column_2", "a_2", "a_3"]
    assert looks_like_header(["x", "y", "z", 1.0][:3]) and not looks_like_header(["x", 1.0, 2.0])
    names, rows = parse_sheet([["soil", None, "air"], ["dry", "wet", "air"], [1.0, 2.0, 3.0]])
    assert names == ["soil-dry", "soil-wet", "air"] and rows == [[1.0, 2.0, 3.0]]
    assert sheet_strategy([{"a"}]) == "single" and sheet_strategy([{"a", "b"}, {"a", "b"}]) == "merged" and sheet_strategy([{"a"}, {"b"}]) == "separate"


def sheet(names, n, seed):
    r = random.Random(seed)
    return [["time", *names]] + [[(46000 + k / 24,), *(round(r.gauss(10, 3), 2) for _ in names)] for k in range(n)]


def test_workbooks(spark):
    merged = read_xlsx(spark, xlsx({"2023": sheet("ab", 30, 1), "2024": sheet("ab", 20, 2), "empty": []}))
    assert merged.strategy == "merged" and merged.skipped == ["empty"] and merged.df.count() == 50
    a = analyze_workbook(merged)
    assert a.profile.time == "time" and a.profile.numeric == ["a", "b"]
    separate = read_xlsx(spark, xlsx({"x": sheet("ab", 30, 1), "y": sheet("cd", 10, 2), "z": [["n"], ["p"], ["q"]]}))
    assert separate.strategy == "separate"
    a = analyze_workbook(separate, indicators=[*config.CORE, "sampling", "correlation"])  # checks of whole tables beside the core ones
    assert set(a.table_checks["sampling"]["per_sheet_scores"]) == {"x", "y"}
    scores, rows = a.table_checks["sampling"]["per_sheet_scores"], {n: s.profile.rows for n, s in a.sheets.items()}
    assert a.table_checks["sampling"]["score"] == pytest.approx(sum(scores[n] * rows[n] for n in rows) / sum(rows.values()), abs=0.02)
    assert all(len(c["reasons"]) <= 10 and c["risk"] == ("ok" if c["score"] >= 70 else "attention") for c in a.table_checks.values())
    assert set(a.sheets) == {"x", "y"} and a.profile.numeric == ["a", "b", "c", "d"]  # the sheets' columns, in their order
    assert not a.table_checks["correlation"]["skipped"]
    few = analyze_workbook(read_xlsx(spark, xlsx({"x": sheet("a", 30, 1), "y": sheet("c", 12, 2)})), indicators=["digit", "correlation"])
    assert few.table_checks["correlation"] == {"score": None, "risk": "skipped", "per_sheet_scores": {}, "reasons": ["No sheet has columns enough for this check."], "skipped": True}
    want = sum(s.sub_scores["digit"] * s.profile.rows for s in a.sheets.values()) / 40
    assert a.sub_scores["digit"] == pytest.approx(want, abs=0.01)
    assert {r["column"] for r in a.results.collect()} >= {"x / a", "y / c"}
    with pytest.raises(ValueError):
        read_xlsx(spark, xlsx({"e": []}))


def test_folder_of_workbooks(spark, tmp_path):
    """A partition for each file and sheet; rows stream through tasks, the driver gets a row for each sheet."""
    many = 60_000
    books = {"a.xlsx": {"s": [["n", "v", "t"], *[[float(k), k / 2, "x"] for k in range(many)]], "u": sheet("nv", 30, 1)}, "b.xlsx": {"s": [["n", "v"], [1.0, "late text"], [2.0, 3.5]]}}
    for name, sheets in books.items():
        (tmp_path / name).write_bytes(xlsx(sheets))
    (tmp_path / "other.txt").write_text("not a workbook")
    for direct in (True, False):
        book = read_xlsx(spark, str(tmp_path), direct)
        assert list(book.sheets) == ["a.xlsx / s", "a.xlsx / u", "b.xlsx / s"] and book.strategy == "separate"
        assert book.df.rdd.getNumPartitions() == 3 and book.sheets["a.xlsx / s"].rdd.getNumPartitions() == 1
        assert dict(book.df.dtypes)["v"] == "string" and dict(book.sheets["a.xlsx / s"].dtypes)["v"] == "double"
        assert book.df.count() == many + 32 and book.df.select(profile.ROW).distinct().count() == many + 32
        last = book.sheets["a.xlsx / s"].where(F.col(profile.ROW) == many - 1).first()
        assert (last["n"], last["v"], last["t"]) == (many - 1.0, (many - 1) / 2, "x")
        assert [r["v"] for r in book.df.where(f"{profile.SHEET} = 'b.xlsx / s'").orderBy(profile.ROW).collect()] == ["late text", "3.5"]


def test_file_from_disk(spark, tmp_path):
    for name in ("b.xlsx", "two words.XLSX"):
        path = tmp_path / name
        path.write_bytes(xlsx({"only": sheet("ab", 25, 3)}))
        (tmp_path / f"~${name}").write_text("an open workbook's lock")
        assert read(spark, str(path)).df.count() == 25
    assert read_xlsx(spark, str(tmp_path)).df.count() == 50
    assert analyze_file(spark, str(path)).ok


def test_configuration():
    assert config.parse_indicators('["digit", "digit", "nope"]') == ["digit"]
    assert config.selection("ml_anomaly, smoothness") == ["smoothness", "ml_anomaly"]
    assert config.selection(None) == list(config.CORE) and config.selection("x") == list(config.CORE)
    assert config.weights(config.CORE)["physical"] == pytest.approx(1.25 / 4.25, abs=1e-6)
    assert config.weights(config.CORE, "moon") == config.weights(config.CORE, "auto")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(config.ALL), min_size=1, unique=True), st.sampled_from(config.SCENARIOS))
def test_weights_sum_to_one(names, scenario):
    assert sum(config.weights(names, scenario).values()) == pytest.approx(1, abs=1e-5)


def test_top_reasons(spark):
    from credlens.operators.results import SCHEMA as RESULTS

    reason = lambda t, i=False: {"text": t, "informational": i}
    rows = [("b", "digit", 9, 80.0, "ok", {}, [reason("late")]), ("a", "smoothness", 9, 40.0, "attention", {}, [reason("first"), reason("hidden", True)]), ("(table)", "sampling", 9, 82.0, "ok", {}, [reason("no time", True)])]
    assert [r["reason"] for r in scoring.top_reasons(spark.createDataFrame(rows, RESULTS)).collect()] == ["a: first", "b: late"]
    ties = [("(table)", "physical", 9, 40.0, "ok", {}, [reason("p")]), ("s / (table)", "correlation", 9, 40.0, "ok", {}, [reason("c")]), ("(table)", "correlation", 9, 40.0, "ok", {}, [reason("d")]), ("a", "digit", 9, 40.0, "ok", {}, [reason("x")]), ("b", "digit", 9, 40.0, "ok", {}, [reason("y")])]
    found = spark.createDataFrame(ties, RESULTS)
    assert scoring.reasons(found, ["b", "a"], "capped") == ["capped", "b: y", "a: x", "d", "s: c", "physical: p"]
    assert scoring.reasons(found.limit(0), [], None) == [scoring.NOTHING]


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"1\n2",x\n3,NA\n')
    from credlens.sources.readers import read_csv

    assert [(r["a"], r["b"]) for r in read_csv(spark, str(path), multi_line=True).collect()] == [("1\n2", "x"), ("3", None)]


def test_stream_agrees_with_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("ts", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windowed_checks(stream, "ts", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("checks").trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = lambda df: sorted((r["window_start"], r["n"], round(r["mean"], 6)) for r in df.collect())
    assert key(spark.table("checks")) == key(windowed_checks(events, "ts", "value", "1 day"))


@pytest.mark.parametrize("word", ["序号", "编号", "代码", "编码", "行政区代码"])
def test_identifier_words(word):
    assert profile.is_identifier(f"样地{word}") and not profile.is_identifier("区划面积")


def test_profile_without_a_shuffle_of_cells(spark):
    n = 500
    rows = [(k, f"2026-01-{1 + k // 24:02d} {k % 24:02d}:00", float(k % 2), [1.0, 2.0, 3.0][k % 3], str(k % 2 + 0.5), str(k * 7 % 31), None, float("nan") if k == 3 else 1.0, k * 1.5) for k in range(n)]
    df = spark.createDataFrame(rows, f"`{profile.ROW}` long, t string, two double, three double, texts string, many string, none double, nan double, v double")
    about, exact = ({s.column: s for s in profile.profile(df, exact=e).stats} for e in (False, True))
    assert {c: s.distinct for c, s in exact.items()} == {"t": n, "two": 2, "three": 3, "texts": 2, "many": 31, "none": 0, "nan": 2, "v": n}
    for c, s in about.items():
        assert (s.distinct >= 3) == (exact[c].distinct >= 3) and s.distinct == pytest.approx(exact[c].distinct, rel=0.06)
    found = profile.profile(df)
    assert found.time == "t" and found.numeric == profile.profile(df, exact=True).numeric == ["three", "many", "v"]


@pytest.mark.parametrize("fall", [None, 0, 99, 100, 250, 399])
def test_order_from_tasks_pieces(spark, fall):
    """Rows in order over several tasks, rows in no order, gaps, and a fall within a task or between two."""
    x = [k // 3 if k % 5 else None for k in range(400)]
    if fall is not None:
        x[fall] = -1 if fall else 1000
        x[399] = x[399] or 0
    rows = [(k, v, 400 - k) for k, v in enumerate(x)]
    schema = f"`{profile.ROW}` long, x long, down long"
    values = [v for v in x if v is not None]
    want = {"x": all(b >= a for a, b in zip(values, values[1:], strict=False)), "down": False}
    in_order = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), schema)
    mixed = spark.createDataFrame(random.Random(1).sample(rows, 400), schema)
    for df in (in_order, mixed, in_order.where("x is null or x >= 0")):
        if df is not mixed and df is not in_order:
            values = [v for v in x if v is not None and v >= 0]
            want = {"x": all(b >= a for a, b in zip(values, values[1:], strict=False)), "down": False}
        assert profile.never_falls(df, ["x", "down"]) == want
    assert profile.never_falls(in_order.limit(0), ["x"]) == {}


def test_sub_score_table(spark):
    scores = spark.createDataFrame([(1, "digit", 49.5), (0, "smoothness", 71.0)], "seq int, indicator string, score double")
    assert [tuple(r) for r in scoring.sub_score_table(scores).collect()] == [("smoothness", "Smoothness", 71.0, "low"), ("digit", "Digit patterns", 49.5, "high")]
    assert [r["weight"] for r in scoring.sub_score_table(scores, {"smoothness": 0.254}).collect()] == ["25%", "0%"]


def test_bar_chart(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.25, 3.15, 7.0, 0.5, 2.25, None])], "i long, v double")
    assert {r["digit"]: r["count"] for r in report.bar_chart(ordered(df, ["v"], ["i"])).collect()} == {5: 4, 7: 1}


def test_report_names():
    from credlens.__main__ import report_path

    assert str(report_path("out", "hdfs://x/a b/plot 7*.csv")) == "out/plot_7_.csv.html"
    assert len(report_path("o", "/" + "n" * 300).name) == 85


def test_short_tables_are_told(spark):
    """A check that has too few values says so among the first reasons."""
    df = spark.createDataFrame([(f"2026-01-01 00:{k:02d}", float(k * k % 7)) for k in range(12)], "at string, well_ph double")
    a = analyze(df, indicators=["outlier", "drift", "changepoint"])
    assert a.reasons[0].endswith("There are too few values for this check.") and sum("too few values" in r for r in a.reasons) >= 2


def test_tables_between_steps_are_removed(spark):
    from pathlib import Path

    from credlens.functions import discard, scratch, written
    from credlens.functions.tables import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    kept = written(spark.range(5), "kept")
    before = set(folder.iterdir())
    with scratch(spark):
        inner = written(spark.range(3), "inner")
        assert inner.count() == 3 and len(set(folder.iterdir()) - before) == 1
    a = analyze(spark.createDataFrame(natural(), SCHEMA), indicators=list(config.ALL), block=16)
    assert a.ok and a.preview.count() == 30 and a.results.count() > 9 and set(folder.iterdir()) == before
    discard(kept)
    discard(spark.range(1))
    assert len(before - set(folder.iterdir())) == 1
