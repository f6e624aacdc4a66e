"""From indicator results to a total: DataFrame operations over one row for each column and indicator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk_level
from . import config

#: Total scores are capped if a core indicator is this low.
GUARD = ((35.0, 59.99), (50.0, 69.99))
TOP = 12


def sub_scores(results: DataFrame, selected: list[str]) -> DataFrame:
    """indicator and score: the mean over columns, rounded to 2 places; 50 for an indicator without results."""
    names = results.sparkSession.createDataFrame([(k, n) for k, n in enumerate(selected)], "seq int, indicator string")
    means = results.groupBy("indicator").agg(F.round(F.avg("score"), 2).alias("score"))
    return names.join(F.broadcast(means), "indicator", "left").select("seq", "indicator", F.coalesce("score", F.lit(50.0)).alias("score"))


def total(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One row: raw_total_score, total_score (after the guardrail), risk_level and adjustment."""
    shares = scores.sparkSession.createDataFrame(list(weights.items()), "indicator string, weight double")
    core = F.min(F.when(F.col("indicator").isin(*config.CORE), F.col("score")))
    sums = scores.join(F.broadcast(shares), "indicator").agg(F.round(F.sum(F.col("score") * F.col("weight")), 2).alias("raw_total_score"), core.alias("core"))
    return guarded(sums)


def guarded(sums: DataFrame) -> DataFrame:
    """sums: raw_total_score and core (the lowest core score, null if there is none)."""
    raw, capped, note = F.col("raw_total_score"), F.col("raw_total_score"), F.lit(None).cast("string")
    for floor, most in reversed(GUARD):
        low = (F.col("core") < floor) & (raw > most)
        capped, note = F.when(low, most).otherwise(capped), F.when(low, f"A core indicator is below {floor:g}: the total is capped at {most}.").otherwise(note)
    # a low core score that needs no cap of its own doesn't fall under the next one's either, as that is higher
    out = sums.select("raw_total_score", "core", capped.alias("total_score"), note.alias("adjustment"))
    return out.select("*", risk_level(F.col("total_score")).alias("risk_level"))


#: What is said if there is nothing to say.
NOTHING = "No clear high-risk pattern was found. Go on with the instruments, the crop and the rules of the field in mind."


def top_reasons(results: DataFrame, n: int = TOP, columns: Sequence[str] = ()) -> DataFrame:
    """score and reason, of the lowest scores first; informational ones are left out. Ties stand in the order of columns (by
    name, where it isn't given), then come those of the correlation, then those of the other checks of whole tables."""
    order = F.array_position(F.array(*map(F.lit, config.ALL)), F.col("indicator"))
    of_table = F.col("column").eqNullSafe("(table)") | F.col("column").endswith(" / (table)")
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")) if columns else F.lit(0)
    group = F.when(~of_table, 0).when(F.col("indicator") == "correlation", 1).otherwise(2)
    label = F.regexp_replace("column", r"\(table\)$", "")
    name = F.when(~of_table, F.col("column")).when(F.col("indicator") == "correlation", F.regexp_replace(label, " / $", "")).otherwise(F.concat(label, "indicator"))
    rows = results.select("column", "score", order.alias("seq"), group.alias("group"), place.alias("place"), name.alias("name"), F.posexplode("reasons").alias("k", "r")).where("not r.informational")
    kept = rows.orderBy("score", "group", "place", "column", "seq", "k").limit(n)
    return kept.select("score", F.concat_ws(": ", F.when(F.col("name") != "", F.col("name")), "r.text").alias("reason"))


def reasons(results: DataFrame, columns: Sequence[str], adjustment: str | None) -> list[str]:
    """What is told of an analysis: why the total was capped, then the top reasons, or that there are none."""
    found = [r["reason"] for r in top_reasons(results, columns=columns).collect()] or [NOTHING]
    return [*([adjustment] if adjustment else []), *found]


def roll_up(per_sheet: DataFrame) -> DataFrame:
    """indicator and score over sheets: means weighted by rows (1 at least). per_sheet: sheet, rows, indicator, score."""
    w = F.greatest("rows", F.lit(1))
    return per_sheet.groupBy("indicator").agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 2).alias("score"))


def sub_score_table(scores: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The sub-scores for display, in their order: label, score and risk level, and the weight as a percentage if weights are given."""
    label = F.create_map(*[F.lit(x) for pair in config.LABELS.items() for x in pair])[F.col("indicator")]
    rows = scores.orderBy("seq").select("indicator", label.alias("label"), "score", risk_level(F.col("score")).alias("risk"))
    if weights is None:
        return rows
    share = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])[F.col("indicator")]
    return rows.withColumn("weight", F.format_string("%.0f%%", F.coalesce(share, F.lit(0.0)) * 100))
