"""Outliers: z-scores, the interquartile rule and isolation depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ramp_down, ramp_up
from .forest import isolation_rate
from .ordered import Ordered, quantiles
from .results import Reason, results

LEAST = 12


def outliers(series: Ordered, forest: bool = True) -> DataFrame:
    """forest=False leaves out the isolation rate (then null, and not part of the combined rate)."""
    bounds = quantiles(series.values, "x", [0.25, 0.75], series.counts, series.block)
    iqr = F.when(F.col("q1") > F.col("q0"), F.col("q1") - F.col("q0")).otherwise(1e-9)
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9)
    rows = series.values.join(F.broadcast(bounds), "series")
    rate = lambda condition: F.avg(condition.cast("double"))
    rates = rows.groupBy("series").agg(
        F.first("n").alias("n"), F.first(sd).alias("spread"), F.first("mean").alias("mean"),
        rate(F.abs((F.col("x") - F.col("mean")) / sd) > 3).alias("z"),
        rate((F.col("x") < F.col("q0") - 1.5 * iqr) | (F.col("x") > F.col("q1") + 1.5 * iqr)).alias("iqr"),
    )
    rates = rates.join(isolation_rate(series), "series", "left") if forest else rates.withColumn("isolation", F.lit(None).cast("double"))
    no, many, few = (F.col(f"{k}_outlier_penalty") > 0 for k in ("no_natural", "many", "few"))
    return results(
        rates, "outlier",
        {
            "z_outlier_rate": F.col("z"), "iqr_outlier_rate": F.col("iqr"), "isolation_forest_rate": F.col("isolation"),
            "natural_rule_rate": F.greatest("z", "iqr"), "combined_outlier_rate": F.greatest("z", "iqr", "isolation"),
            "variation_cv": F.col("spread") / (F.abs("mean") + 1e-9),
        },
        {
            "no_natural_outlier_penalty": ramp_down(F.col("natural_rule_rate"), 0.02, 0, 28),
            "many_outlier_penalty": ramp_up(F.col("combined_outlier_rate"), 0.25, 1, 24),
            "few_outlier_penalty": F.when(F.col("n") >= 50, ramp_down(F.col("combined_outlier_rate"), 0.02, 0, 10)).otherwise(0.0),
            "low_cv_penalty": ramp_down(F.col("variation_cv"), 0.005, 0, 16),
        },
        [
            Reason("Neither z-scores nor quartiles show the outliers that measurements usually have.", no),
            Reason("There are very many outliers.", ~no & many),
            Reason("There are very few outliers.", ~no & ~many & few),
            Reason("The share of outliers can be explained.", ~no & ~many & ~few, informational=True),
            Reason("Values vary very little around their mean.", F.col("low_cv_penalty") > 0),
        ],
        least=LEAST,
    )
