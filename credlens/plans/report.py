"""Payload and HTML report of an analysis. The score is a prompt for review, never a verdict that data is false."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.changepoint import changepoint
from ..operators.ordered import Ordered
from .analysis import Analysis
from .config import LABELS

NOTE = "The score points to what should be reviewed. It is no verdict that data is false."


def json_safe(value):
    """Values that JSON can hold: numbers that aren't finite become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v) for v in value]
    return value if value is None or isinstance(value, str | int | bool) else str(value)


def payload(a: Analysis) -> dict:
    rows = [r.asDict(True) for r in a.results.collect()] if a.results is not None else []
    out = {
        "ok": a.ok, "note": NOTE, "strategy": a.strategy,
        "profile": {"time_column": a.profile.time, "numeric_columns": a.profile.numeric, "rows": a.profile.rows, "columns": a.profile.columns, "missing_rate": a.profile.missing_rate},
        "screening": [r.asDict() for r in a.screening.collect()], "selected": a.selected, "weights": a.weights, "sub_scores": a.sub_scores, "total": a.total,
        "results": rows, "reasons": a.reasons, "table_checks": a.table_checks, "sheets": {n: payload(s) for n, s in a.sheets.items()},
        "preview": [r.asDict(True) for r in a.preview.collect()] if a.preview is not None else [],
    }
    return json_safe(out)


def to_json(a: Analysis) -> str:
    return json.dumps(payload(a), ensure_ascii=False)


def _table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</{tag}>" for v in row)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def to_html(a: Analysis, title: str = "Data credibility report") -> str:
    p = payload(a)
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:15px sans-serif;max-width:60em;margin:2em auto}}td,th{{border:1px solid #ccc;padding:.2em .6em;text-align:left}}table{{border-collapse:collapse}}</style>", f"<h1>{html.escape(title)}</h1><p>{NOTE}</p>"]
    if p["total"]:
        parts.append(f"<h2>Score {p['total']['total_score']:.2f}: {p['total']['risk_level']} risk</h2>" + (f"<p>{html.escape(p['total']['adjustment'])}</p>" if p["total"]["adjustment"] else ""))
        parts.append(_table(["indicator", "score", "weight"], [[LABELS[k], v, p["weights"].get(k)] for k, v in p["sub_scores"].items()]))
        parts.append("<h2>What to review</h2><ul>" + "".join(f"<li>{html.escape(r)}</li>" for r in p["reasons"]) + "</ul>")
        parts.append("<h2>Results</h2>" + _table(["column", "indicator", "score", "risk", "metrics"], [[r["column"], LABELS[r["indicator"]], r["score"], r["risk"], ", ".join(f"{k} {v:.4g}" for k, v in r["metrics"].items() if v is not None)] for r in p["results"]]))
    else:
        parts.append("<p>No numeric column could be scored.</p>")
    parts.append("<h2>Columns</h2>" + _table(["column", "role", "missing", "different values", "handling"], [[s["column"], s["role"], s["missing_rate"], s["unique_count"], s["handling"]] for s in p["screening"]]))
    parts += [f"<h2>Sheet {html.escape(n)}</h2>" + _table(["indicator", "score"], [[LABELS[k], v] for k, v in s["sub_scores"].items()]) for n, s in p["sheets"].items()]
    return "".join(parts)


def line_chart(series: Ordered, points: int = 500) -> DataFrame:
    """series, at, lo, hi and mean of at most that many stretches of each series: what a line chart shows."""
    at = F.floor(F.col("i") * F.least(F.lit(points), F.col("n")) / F.col("n"))
    return series.rows.groupBy("series", at.alias("at")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))


def changepoint_chart(series: Ordered, points: int = 500) -> DataFrame:
    """The rows of the line chart with mark: whether the likely change point lies in the stretch."""
    point = changepoint(series).select(F.col("column").alias("series"), F.col("metrics")["likely_changepoint_index"].alias("point"))
    counts = series.df.sparkSession.createDataFrame(list(series.counts.items()), "series string, n long")
    marks = counts.join(point, "series", "left").select("series", F.floor(F.col("point") * F.least(F.lit(points), F.col("n")) / F.col("n")).alias("marked"))
    chart = line_chart(series, points).join(F.broadcast(marks), "series", "left")
    return chart.withColumn("mark", F.coalesce(F.col("at") == F.col("marked"), F.lit(False))).drop("marked")


def bar_chart(series: Ordered) -> DataFrame:
    """series, digit and count: how often each last digit occurs."""
    from ..operators.digits import last_digit, places

    return series.values.groupBy("series", last_digit(F.col("x"), places(F.col("x"))).alias("digit")).count()
