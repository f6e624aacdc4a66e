"""A table or workbook from end to end: profile, indicators, scores, reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch
from ..operators import anomaly, changepoint, correlation, digits, drift, outliers, physical, profile, sampling, smoothness, timeseries
from ..operators.ordered import BLOCK, Ordered, ordered
from ..sources.readers import read, with_rows
from ..sources.workbook import Workbook
from . import config, scoring

#: Registry of column indicators: functions of the ordered series.
COLUMN_INDICATORS = {
    "smoothness": smoothness.smoothness, "digit": digits.digits, "outlier": outliers.outliers,
    "timeseries": timeseries.timeseries, "drift": drift.drift, "changepoint": changepoint.changepoint,
}


@dataclass
class Analysis:
    profile: profile.Profile
    screening: DataFrame
    selected: list[str]
    weights: dict[str, float]
    #: A row for each column and indicator; None if the table has no numeric column.
    results: DataFrame | None = None
    sub_scores: dict[str, float] = field(default_factory=dict)
    total: dict | None = None
    reasons: list[str] = field(default_factory=list)
    preview: DataFrame | None = None
    sheets: dict[str, Analysis] = field(default_factory=dict)
    #: Separate sheets: what each check of whole tables found over all of them.
    table_checks: dict[str, dict] = field(default_factory=dict)
    strategy: str = "single"

    @property
    def ok(self) -> bool:
        return self.total is not None


def series_of(df: DataFrame, found: profile.Profile, block: int = BLOCK) -> Ordered:
    """All numeric columns in time order, ties and rows without time in row order."""
    return ordered(df, found.numeric, [*([found.time] if found.time else []), profile.ROW], block)


def indicator_results(df: DataFrame, found: profile.Profile, selected: Sequence[str], scenario: str | None, mismatch: float = 0.0, skipped: int = 0, block: int = BLOCK, series: Ordered | None = None) -> DataFrame:
    """Only the selected indicators become part of the plan. series: the table's ordered series, if the caller keeps them."""
    prepared = profile.prepare(df, found)
    parts = []
    if wanted := [n for n in selected if n in config.COLUMN]:
        series = series or series_of(prepared, found, block)
        parts += [COLUMN_INDICATORS[n](series) for n in wanted]
    if "sampling" in selected:
        parts.append(sampling.sampling(prepared, found.time, mismatch, skipped, block))
    if "physical" in selected:
        parts.append(physical.physical(prepared, found.numeric, scenario))
    if "correlation" in selected:
        parts.append(correlation.correlation(prepared, found.numeric, block))
    if "ml_anomaly" in selected:
        parts.append(anomaly.anomaly(prepared, found.numeric))
    return reduce(lambda a, b: a.unionByName(b), parts)


def analyze(df: DataFrame, scenario: str | None = "auto", indicators=None, *, mismatch: float = 0.0, skipped: int = 0, block: int = BLOCK) -> Analysis:
    """One table."""
    with scratch(df.sparkSession):  # all that is lazy in the end reads df alone
        return _analyze(df, scenario, indicators, mismatch, skipped, block)


def _analyze(df: DataFrame, scenario: str | None, indicators, mismatch: float, skipped: int, block: int) -> Analysis:
    df = df if profile.ROW in df.columns else with_rows(df)
    found = profile.profile(df, block)
    selected = config.selection(indicators)
    out = Analysis(found, profile.screening(df, found), selected, config.weights(selected, scenario), preview=profile.preview(df, found))
    if found.numeric:
        series = series_of(profile.prepare(df, found), found, block)
        if any(n in config.COLUMN for n in selected):
            series.pieces  # cut first, all column indicators read them
        # the results number a row for each column and indicator
        out.results = df.sparkSession.createDataFrame(indicator_results(df, found, selected, scenario, mismatch, skipped, block, series).collect(), results_schema())
        scores = scoring.sub_scores(out.results, selected)
        out.sub_scores = {r["indicator"]: r["score"] for r in scores.orderBy("seq").collect()}
        out.total = scoring.total(scores, out.weights).first().asDict()
        out.reasons = scoring.reasons(out.results, found.numeric, out.total["adjustment"])
    return out


def results_schema() -> str:
    from ..operators.results import SCHEMA

    return SCHEMA


#: Reasons of a sheet, and of all sheets, that a check of whole tables tells.
EACH_SHEET, ALL_SHEETS = 3, 10


def table_checks(sheets: dict[str, Analysis]) -> dict[str, dict]:
    """For each check of whole tables: its score over sheets (a mean weighted by rows), its risk, each sheet's score, and
    reasons. Sheets with too few columns to correlate take no part in that check, which is told as skipped if none does."""
    held: dict[str, list[tuple[str, int, dict]]] = {}
    for name, a in sheets.items():
        for r in a.results.where(F.col("column") == "(table)").collect():  # a row a check
            if r["metrics"] or r["indicator"] != "correlation":
                held.setdefault(r["indicator"], []).append((name, max(a.profile.rows, 1), r.asDict(True)))
    out = {}
    for indicator, found in held.items():
        score = round(sum(r["score"] * rows for _, rows, r in found) / sum(rows for _, rows, _ in found), 2)
        told = [f"{n}: {x['text']}" for n, _, r in found for x in r["reasons"][:EACH_SHEET]][:ALL_SHEETS]
        out[indicator] = {
            "score": score, "risk": "ok" if score >= 70 else "attention", "per_sheet_scores": {n: round(r["score"], 2) for n, _, r in found},
            "reasons": told or ["No sheet shows a clear risk as a whole."], "skipped": False,
        }
    if "correlation" not in out:
        chosen = any("correlation" in a.selected for a in sheets.values())
        why = "No sheet has columns enough for this check." if chosen else "This check wasn't selected."
        out["correlation"] = {"score": None, "risk": "skipped", "per_sheet_scores": {}, "reasons": [why], "skipped": True}
    return out


def analyze_workbook(book: Workbook, scenario: str | None = "auto", indicators=None, block: int = BLOCK) -> Analysis:
    """A workbook: merged sheets as one table, separate ones one by one and rolled up by their rows."""
    if book.strategy != "separate":
        out = analyze(book.df, scenario, indicators, mismatch=sampling.structure_mismatch(book.df.drop(profile.ROW)), skipped=len(book.skipped), block=block)
        out.strategy = book.strategy
        return out
    spark = book.df.sparkSession
    sheets = {n: a for n, df in book.sheets.items() if (a := analyze(df, scenario, indicators, block=block)).ok}
    if not sheets:
        return analyze(book.df, scenario, indicators, block=block)
    first = next(iter(sheets.values()))
    rows = [(n, a.profile.rows, k, s) for n, a in sheets.items() for k, s in a.sub_scores.items()]
    rolled = scoring.roll_up(spark.createDataFrame(rows, "sheet string, rows long, indicator string, score double"))
    found = profile.profile(book.df, block)
    if own := list(dict.fromkeys(c for a in sheets.values() for c in a.profile.numeric)):  # what is scored are the sheets' columns
        found = replace(found, numeric=own)
    out = Analysis(found, profile.screening(book.df, found), first.selected, first.weights, sheets=sheets, strategy="separate", preview=profile.preview(book.df, found))
    prefixed = [a.results.withColumn("column", F.concat(F.lit(f"{n} / "), "column")) for n, a in sheets.items()]
    out.results = reduce(lambda a, b: a.unionByName(b), prefixed)
    out.sub_scores = {r["indicator"]: r["score"] for r in rolled.collect()}
    out.total = scoring.total(rolled, first.weights).first().asDict()
    out.table_checks = table_checks(sheets)
    out.reasons = scoring.reasons(out.results, [f"{n} / {c}" for n, a in sheets.items() for c in a.profile.numeric], out.total["adjustment"])
    return out


def analyze_file(spark: SparkSession, path: str, scenario: str | None = "auto", indicators=None) -> Analysis:
    return analyze_workbook(read(spark, path), scenario, indicators)
