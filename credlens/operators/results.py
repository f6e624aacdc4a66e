"""Indicator results: one row for each series, with score, risk, metrics and reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp_score, risk_flag

SCHEMA = "column string, indicator string, n long, score double, risk string, metrics map<string,double>, reasons array<struct<text:string,informational:boolean>>"
NOTHING = "No conspicuous pattern was found."
#: Told like any finding: a check that could not be made is to be known.
TOO_FEW = "There are too few values for this check."


@dataclass(frozen=True)
class Reason:
    text: str
    when: Column
    #: Left out of the top reasons.
    informational: bool = False


def results(
    rows: DataFrame, indicator: str, metrics: dict[str, Column], penalties: dict[str, Column], reasons: Sequence[Reason],
    *, least: int = 0, short: tuple[float, str] = (50.0, "insufficient_data"), attention: float = 30, told: Column | None = None,
) -> DataFrame:
    """rows: one for each series, with series, n and what metrics and penalties (over the rows' columns, then over
    metrics) are made of. Series shorter than least get the short score. told: texts (an array) that come before the reasons."""
    for name, value in (metrics | penalties).items():
        rows = rows.withColumn(name, value.cast("double"))
    penalty = sum((F.col(p) for p in penalties), F.lit(0.0))
    enough = F.col("n") >= least
    pairs = [x for name in (*metrics, *penalties) for x in (F.lit(name), F.col(name))]
    texts = F.array(*[F.when(r.when, F.struct(F.lit(r.text).alias("text"), F.lit(r.informational).alias("informational"))) for r in reasons])
    texts = F.filter(texts, lambda r: r.isNotNull())
    if told is not None:
        texts = F.concat(F.transform(told, lambda t: F.struct(t.alias("text"), F.lit(False).alias("informational"))), texts)
    note = lambda text, informational: F.array(F.struct(F.lit(text).alias("text"), F.lit(informational).alias("informational")))
    return rows.select(
        F.col("series").alias("column"), F.lit(indicator).alias("indicator"), F.col("n").cast("long").alias("n"),
        F.when(enough, clamp_score(100 - penalty)).otherwise(short[0]).alias("score"),
        F.when(enough, risk_flag(penalty, attention)).otherwise(short[1]).alias("risk"),
        F.when(enough, F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,double>")).alias("metrics"),
        F.when(~enough, note(TOO_FEW, False)).when(F.size(texts) == 0, note(NOTHING, True)).otherwise(texts).alias("reasons"),
    )
