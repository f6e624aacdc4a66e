"""Physical rules: hard and soft bounds by column name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, ramp_up
from .results import Reason, results


@dataclass(frozen=True)
class Rule:
    key: str
    patterns: tuple[str, ...]
    soft: tuple[float, float]
    hard: tuple[float, float]


# Rules by parts of column names, with inclusive soft and hard bounds. The first that matches holds.
COMMON = (
    Rule("temperature", ("温度", "气温", "temperature", "temp"), (-20, 60), (-50, 80)),
    Rule("humidity", ("湿度", "humidity", "rh"), (0, 100), (0, 100)),
    Rule("soil_moisture", ("土壤水", "墒情", "soil_moisture", "moisture"), (0, 100), (0, 100)),
    Rule("rainfall", ("降雨", "雨量", "rain", "rainfall", "precip"), (0, 300), (0, 1000)),
    Rule("light", ("光照", "照度", "light", "lux"), (0, 200000), (0, 250000)),
    Rule("ph", ("ph", "酸碱"), (3, 10), (0, 14)),
    Rule("ec", ("ec", "电导", "conductivity"), (0, 20), (0, 50)),
    Rule("co2", ("co2", "二氧化碳"), (250, 5000), (0, 10000)),
    Rule("yield", ("产量", "yield"), (0, 30000), (0, 100000)),
    Rule("pesticide_residue", ("农药残留", "残留", "residue", "pesticide"), (0, 50), (0, 1000)),
)
EXTRA = {
    "auto": (),
    "greenhouse": (),
    "pest": (
        Rule("pest_count", ("卵", "幼虫", "成虫", "虫量", "诱捕", "螟", "蛾", "count"), (0, 100000), (0, 1000000)),
        Rule("rate", ("率", "比例", "percent", "rate"), (0, 100), (0, 100)),
    ),
    "yield": (
        Rule("area", ("面积", "area"), (0, 100000), (0, 10000000)),
        Rule("plant_height", ("株高", "height"), (0, 400), (0, 1000)),
        Rule("weight", ("重量", "千粒重", "weight"), (0, 10000), (0, 100000)),
    ),
    "residue": (
        Rule("detection_limit", ("检出限", "lod", "loq"), (0, 10), (0, 1000)),
        Rule("concentration", ("浓度", "含量", "mg/kg", "ppm"), (0, 1000), (0, 100000)),
    ),
}


def scenario_of(scenario: str | None) -> str:
    return scenario if scenario in EXTRA else "auto"


def match_rule(column: str, scenario: str | None) -> Rule | None:
    name = column.lower()
    return next((r for r in COMMON + EXTRA[scenario_of(scenario)] if any(p.lower() in name for p in r.patterns)), None)


def checks(df: DataFrame, columns: Sequence[str], scenario: str | None = "auto") -> DataFrame:
    """column, rule, lo, hi, hard_rate, soft_rate and penalties of each column with a rule and values; one aggregate."""
    kinds, rules = dict(df.dtypes), {c: r for c in columns if (r := match_rule(c, scenario))}
    schema = "column string, rule string, percent boolean, n long, lo double, hi double, hard_rate double, soft_rate double"
    if not rules:
        found = df.sparkSession.createDataFrame([], schema)
    else:
        aggregates = []
        for k, (c, r) in enumerate(rules.items()):
            x = numeric(F.col(f"`{c}`"), kinds[c])
            hard, soft = (x < r.hard[0]) | (x > r.hard[1]), (x < r.soft[0]) | (x > r.soft[1])
            aggregates += [F.count(x).alias(f"n{k}"), F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}"), F.avg(hard.cast("double")).alias(f"h{k}"), F.avg((soft & ~hard).cast("double")).alias(f"s{k}")]
        structs = [
            F.struct(F.lit(c).alias("column"), F.lit(r.key).alias("rule"), F.lit("率" in c).alias("percent"), F.col(f"n{k}").alias("n"), F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi"), F.col(f"h{k}").alias("hard_rate"), F.col(f"s{k}").alias("soft_rate"))
            for k, (c, r) in enumerate(rules.items())
        ]
        found = df.agg(*aggregates).select(F.explode(F.array(*structs)).alias("r")).select("r.*").where("n > 0")
    share = (F.col("lo") >= 0) & (F.col("hi") <= 1)
    unit = F.greatest(
        F.when(F.col("rule").isin("humidity", "soil_moisture") & share, 6.0).otherwise(0.0),
        F.when((F.col("rule") == "pesticide_residue") & (F.col("lo") < 0), 10.0).otherwise(0.0),
        F.when(F.col("percent") & share, 4.0).otherwise(0.0),
    )
    return found.select("column", "rule", "lo", "hi", "hard_rate", "soft_rate", ramp_up(F.col("hard_rate"), 0, 0.15, 28).alias("hard_penalty"), ramp_up(F.col("soft_rate"), 0.02, 0.30, 16).alias("soft_penalty"), unit.alias("unit_penalty"))


#: What is said of a column; the order is that of the reasons.
SHARE = "values lie between 0 and 1, though the name tells of a percentage: check the unit."
HARD = "values lie outside the physical range: check units and entries first."
SOFT = "values lie outside the usual range: compare with region, crop and device."


def matched_rules(df: DataFrame, columns: Sequence[str], scenario: str | None = "auto") -> DataFrame:
    """column, rule, its soft and hard bounds, the column's least and largest value, the shares of values outside, and notes
    (what is to be looked at, in order), for each column with a rule and values."""
    rules = {c: r for c in columns if (r := match_rule(c, scenario))}
    bounds = [(k, c, *map(float, (*r.soft, *r.hard))) for k, (c, r) in enumerate(rules.items())]
    bounds = df.sparkSession.createDataFrame(bounds, "place int, column string, soft_min double, soft_max double, hard_min double, hard_max double")
    found = checks(df, columns, scenario)
    share = F.col("rule").isin("humidity", "soil_moisture") & (F.col("lo") >= 0) & (F.col("hi") <= 1)
    notes = F.array(F.when(share, SHARE), F.when(F.col("hard_penalty") > 0, HARD), F.when(F.col("soft_penalty") > 0, SOFT))
    rates = [F.round(f"{k}_rate", 4).alias(f"{k}_out_of_range_rate") for k in ("hard", "soft")]
    ends = [F.round("lo", 4).alias("min"), F.round("hi", 4).alias("max")]
    penalties = [F.col(f"{k}_penalty") for k in ("hard", "soft", "unit")]
    return found.join(F.broadcast(bounds), "column").select("place", "column", "rule", "soft_min", "soft_max", "hard_min", "hard_max", *ends, *rates, F.filter(notes, lambda n: n.isNotNull()).alias("notes"), *penalties)


def physical(df: DataFrame, columns: Sequence[str], scenario: str | None = "auto") -> DataFrame:
    said = F.transform("notes", lambda n: F.concat("column", F.lit(": "), n))
    sums = matched_rules(df, columns, scenario).agg(
        F.count("*").alias("matched"), *[F.coalesce(F.sum(f"{k}_penalty"), F.lit(0.0)).alias(k) for k in ("hard", "soft", "unit")],
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda s: s["said"])).alias("told"),  # a row a column
    ).withColumns({"series": F.lit("(table)"), "n": F.lit(len(columns))})
    return results(
        sums, "physical",
        {"matched_rule_count": F.col("matched"), "rule_coverage": F.col("matched") / max(len(columns), 1)},
        {
            "hard_penalty": F.col("hard"), "soft_penalty": F.col("soft"), "unit_penalty": F.col("unit"),
            "coverage_penalty": F.when(F.lit(bool(columns)) & (F.col("rule_coverage") < 0.25), 8.0).otherwise(0.0),
        },
        [
            Reason("Few columns have a rule: choose a closer scenario or fuller names.", F.col("coverage_penalty") > 0),
        ],
        told=F.col("told"),
    )
