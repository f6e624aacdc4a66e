"""Digit patterns: integers, decimal places, last digits, grids and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ramp_up
from .ordered import Ordered
from .results import Reason, results

LEAST = 10
# Parts of column names that tell counts, rates and measurements.
COUNT_HINTS = ("卵块", "卵粒", "幼虫", "成虫", "虫量", "诱捕", "孵化", "寄生", "干瘪", "出蜂", "株数", "数量", "头数", "粒数", "个数", "只数", "count", "number", "quantity", "qty")
RATE_HINTS = ("率", "比例", "percent", "percentage", "rate")
MEASUREMENT_HINTS = (
    "温度", "湿度", "水分", "墒情", "降雨", "雨量", "残留", "浓度", "含量", "产量", "重量", "质量", "株高", "高度", "长度", "面积", "ph", "ec",
    "temp", "temperature", "humidity", "rain", "yield", "residue", "concentration", "weight", "height", "area",
)
KINDS = ("count", "discrete_integer", "rounded_measurement", "rate_or_ratio", "continuous_or_unknown")


def decimal_places(x: Column) -> Column:
    return F.length(F.regexp_replace(F.format_string("%.10f", x), "\\.?0*$", "")) - F.length(F.regexp_replace(F.format_string("%.10f", x), "\\..*$", ""))


def places(x: Column) -> Column:
    """Decimal places: what follows the dot, if anything does."""
    return F.greatest(decimal_places(x) - 1, F.lit(0))


def last_digit(x: Column, decimals: Column) -> Column:
    return (F.bround(F.abs(x) * F.pow(F.lit(10.0), decimals), 0).cast("decimal(38,0)") % 10).cast("int")


def near_zero(x: Column) -> Column:
    return x <= 1e-8


def named(hints: tuple[str, ...]) -> Column:
    name = F.lower(F.trim("series"))
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(name, h))


def shares(series: Ordered) -> DataFrame:
    """The counts that the rates are made of, a row for each series. Values are counted per series and value first, so
    that distinct values and the largest counts need no list of values, and digits are looked at once a value, not once a row."""
    by_value = series.values.groupBy("series", "x").agg(F.count("*").alias("k"), F.first("n").alias("n")).withColumn("places", places(F.col("x")))
    by_value = by_value.withColumn("last", last_digit(F.col("x"), F.col("places"))).withColumn("whole", near_zero(F.pmod("x", F.lit(1.0))))
    by_value = by_value.withColumn("digits", F.when(F.col("whole"), F.length(F.abs(F.bround("x", 0)).cast("decimal(38,0)").cast("string"))))
    count = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("k")).otherwise(0))
    sums = by_value.groupBy("series").agg(
        F.first("n").alias("n"), F.count("*").alias("distinct"), F.min("x").alias("lo"), F.max(F.abs("x")).alias("most"),
        F.sum(F.when(F.col("whole"), F.col("k")).otherwise(0)).alias("whole"),
        F.sum(F.when(near_zero(F.pmod(F.col("x") * 20, F.lit(1.0))), F.col("k")).otherwise(0)).alias("grid"),
        F.array(*[count("places", v) for v in range(11)]).alias("places"), F.array(*[count("last", v) for v in range(10)]).alias("lasts"),
        F.array(*[count("digits", v) for v in range(1, 39)]).alias("digits"),
    )
    return sums.withColumn("whole_rate", F.col("whole") / F.col("n")).withColumn("repeats", 1 - F.col("distinct") / F.col("n")).withColumn("kind", numeric_kind())


def numeric_kind() -> Column:
    lengths = F.size(F.filter("digits", lambda c: c > 0))
    enough = F.col("distinct") >= F.least(F.lit(8), F.greatest(F.lit(3), F.floor(F.col("n") * 0.15)))
    return (
        F.when(named(RATE_HINTS), "rate_or_ratio").when((F.col("whole_rate") < 0.9) | (F.col("lo") < 0), "continuous_or_unknown")
        .when(named(COUNT_HINTS), "count").when(named(MEASUREMENT_HINTS), "rounded_measurement")
        .when((lengths >= 2) & enough & (F.col("repeats") < 0.9), "discrete_integer").otherwise("continuous_or_unknown")
    )


def by_kind(value: str, count: tuple | None, discrete: tuple | None, rounded: tuple, other: tuple) -> Column:
    ramp = lambda p: ramp_up(F.col(value), p[0], p[1], p[2]) if p else F.lit(0.0)
    return F.when(F.col("kind") == "count", ramp(count)).when(F.col("kind") == "discrete_integer", ramp(discrete)).when(F.col("kind") == "rounded_measurement", ramp(rounded)).otherwise(ramp(other))


def digits(series: Ordered) -> DataFrame:
    rows = shares(series)
    integer_like = F.col("kind").isin("count", "discrete_integer")
    small = integer_like & (F.col("most") < 10)
    share = lambda c: F.array_max(c) / F.col("n")
    diversity = F.size(F.filter("digits", lambda c: c > 0))
    is_kind = lambda k: F.col("kind") == k
    return results(
        rows, "digit",
        {
            "integer_rate": F.col("whole_rate"), "dominant_decimal_place_rate": share("places"), "dominant_last_digit_rate": share("lasts"),
            "digit_length_diversity": diversity, "dominant_digit_length_rate": share("digits"), "rounded_0_05_rate": F.col("grid") / F.col("n"),
            "duplicate_rate": F.col("repeats"), "numeric_kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1,
        },
        {
            "integer_penalty": by_kind("integer_rate", None, None, (0.85, 1, 8), (0.75, 1, 24)),
            "decimal_place_penalty": by_kind("dominant_decimal_place_rate", None, None, (0.92, 1, 6), (0.9, 1, 20)),
            "last_digit_penalty": F.when(small, 0.0).otherwise(by_kind("dominant_last_digit_rate", (0.75, 0.98, 8), (0.70, 0.98, 10), (0.45, 1, 10), (0.35, 1, 18))),
            "rounded_0_05_penalty": by_kind("rounded_0_05_rate", None, None, (0.9, 1, 4), (0.8, 1, 16)),
            "duplicate_penalty": by_kind("duplicate_rate", (0.92, 1, 6), (0.85, 1, 8), (0.55, 1, 10), (0.45, 1, 12)),
        },
        [
            Reason("The column counts things: whole numbers are expected and weigh less.", is_kind("count")),
            Reason("The column holds whole numbers of several lengths, which weigh less.", is_kind("discrete_integer")),
            Reason("The column is named like a measurement but holds whole numbers.", is_kind("rounded_measurement")),
            Reason("Whole numbers have several lengths; repeats and last digits are looked at instead.", integer_like & (diversity >= 2)),
            Reason("Nearly all values are whole numbers.", F.col("integer_penalty") > 0),
            Reason("Nearly all values have the same number of decimal places.", F.col("decimal_place_penalty") > 0),
            Reason("Last digits cluster.", F.col("last_digit_penalty") > 0),
            Reason("Values are small whole numbers; last digits say nothing.", (F.col("last_digit_penalty") <= 0) & small),
            Reason("Very many values lie on a grid of 0.05.", F.col("rounded_0_05_penalty") > 0),
            Reason("Whole numbers repeat extremely often: default values or copies?", (F.col("duplicate_penalty") > 0) & integer_like),
            Reason("Values repeat often.", (F.col("duplicate_penalty") > 0) & ~integer_like),
        ],
        least=LEAST,
    )
