"""Indicators, scenarios and weights."""

from __future__ import annotations

import json
from collections.abc import Iterable

ALL = ("smoothness", "digit", "outlier", "physical", "sampling", "timeseries", "drift", "changepoint", "correlation", "ml_anomaly")
CORE, OPTIONAL = ALL[:4], ALL[4:]
#: Indicators of single columns; the others are of the whole table.
COLUMN = ("smoothness", "digit", "outlier", "timeseries", "drift", "changepoint")
LABELS = {
    "smoothness": "Smoothness", "digit": "Digit patterns", "outlier": "Outliers", "physical": "Physical ranges and units", "sampling": "Sampling integrity",
    "timeseries": "Time-series nature", "drift": "Sensor drift", "changepoint": "Change points", "correlation": "Correlation", "ml_anomaly": "Ensemble anomalies",
}
# How much each indicator weighs in each scenario, before the weights are made to sum to 1.
SCENARIOS = ("auto", "greenhouse", "pest", "yield", "residue")
RELEVANCE = {
    "sampling": (0.30, 0.45, 0.25, 0.25, 0.20),
    "smoothness": (0.90, 1.00, 0.45, 0.55, 0.45),
    "digit": (0.95, 0.60, 1.05, 0.95, 1.05),
    "outlier": (1.15, 1.05, 1.10, 1.05, 1.10),
    "physical": (1.25, 1.10, 1.15, 1.20, 1.40),
    "timeseries": (0.75, 1.00, 0.45, 0.45, 0.30),
    "drift": (0.55, 1.00, 0.25, 0.25, 0.20),
    "changepoint": (0.65, 0.80, 0.85, 0.60, 0.55),
    "correlation": (0.70, 0.70, 0.70, 1.00, 0.85),
    "ml_anomaly": (0.80, 0.90, 0.65, 0.70, 0.75),
}


def scenario_of(scenario: str | None) -> str:
    return scenario if scenario in SCENARIOS else "auto"


def parse_indicators(value: str | Iterable[str] | None) -> list[str]:
    """A list, a JSON array or a comma-separated text of names; unknown and repeated ones are dropped."""
    if value is None:
        return []
    if isinstance(value, str):
        try:
            parsed = json.loads(value)
        except ValueError:
            parsed = value.split(",")
        value = parsed if isinstance(parsed, list) else [parsed]
    names = [str(v).strip() for v in value]
    return [n for n in dict.fromkeys(names) if n in ALL]


def selection(value: str | Iterable[str] | None = None, custom: bool = True) -> list[str]:
    """The indicators to run, in their fixed order: those asked for, or the core ones."""
    chosen = parse_indicators(value) if custom else []
    return [n for n in ALL if n in (chosen or CORE)]


def weights(selected: Iterable[str], scenario: str | None = "auto") -> dict[str, float]:
    """Shares of 1, rounded to 6 places."""
    at = SCENARIOS.index(scenario_of(scenario))
    raw = {n: RELEVANCE[n][at] for n in selected}
    return {n: round(w / sum(raw.values()), 6) for n, w in raw.items()}


def indicator_list() -> list[dict]:
    return [{"key": n, "label": LABELS[n], "core": n in CORE, "scope": "column" if n in COLUMN else "table"} for n in ALL]
