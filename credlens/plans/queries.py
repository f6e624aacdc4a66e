"""Registered queries over the driver's tables: one for each operator, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, changepoint, correlation, digits, drift, outliers, physical, profile, sampling, smoothness, timeseries
from ..operators.ordered import BLOCK, Ordered, ordered
from ..sources.readers import union_by_name, with_rows
from ..sources.workbook import jaccard, sheet_strategy
from ..streaming.windows import windowed_checks
from . import config, oracles, scoring
from .analysis import analyze, indicator_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Total orders of the tables' rows.
ORDER = {
    "events": ["ts", "event_id"], "orders": ["o_orderdate", "o_orderkey"],
    "lineitem": ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
}
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, name: str, columns: list[str], block: int = BLOCK) -> Ordered:
    return ordered(table(spark, sf_dir, name), columns, ORDER[name], block)


def flat(results: DataFrame, names: list[str]) -> DataFrame:
    """Results with the named metrics as columns, rounded as in the SQL."""
    return results.select("column", "n", F.round("score", 6).alias("score"), *[F.round(F.col("metrics")[m], 6).alias(m) for m in names])


#: Values of a block where a query shows what long series go through: range partitions, halos, cumulated counts.
SMALL = 700


def indicator(name: str, run: Callable[[Ordered], DataFrame], of: str, columns: list[str], metrics: list[str], oracle: str, block: int = BLOCK) -> None:
    query(name, oracle)(lambda spark, d: flat(run(series(spark, d, of, columns, block)), metrics))


indicator("smooth_score_events", smoothness.smoothness, "events", ["value"], oracles.SMOOTH, oracles.smooth("events", ["value"]))
indicator("smooth_score_orders", smoothness.smoothness, "orders", ["o_totalprice"], oracles.SMOOTH, oracles.smooth("orders", ["o_totalprice"]))
indicator("smooth_score_lineitem", smoothness.smoothness, "lineitem", LINE, oracles.SMOOTH, oracles.smooth("lineitem", LINE))
indicator("ts_score_events", timeseries.timeseries, "events", ["value"], oracles.TIMESERIES, oracles.timeseries("events", ["value"]))
indicator("ts_score_orders", timeseries.timeseries, "orders", ["o_totalprice"], oracles.TIMESERIES, oracles.timeseries("orders", ["o_totalprice"]))
indicator("drift_score_events", drift.drift, "events", ["value"], oracles.DRIFT, oracles.drift("events", ["value"]))
indicator("drift_score_lineitem", drift.drift, "lineitem", LINE, oracles.DRIFT, oracles.drift("lineitem", LINE))
indicator("cp_score_events", changepoint.changepoint, "events", ["value"], oracles.CHANGEPOINT, oracles.changepoint("events", ["value"]))
indicator("cp_score_orders", changepoint.changepoint, "orders", ["o_totalprice"], oracles.CHANGEPOINT, oracles.changepoint("orders", ["o_totalprice"]))
indicator("digit_score_lineitem", digits.digits, "lineitem", LINE, oracles.DIGIT, oracles.digit("lineitem", LINE))
indicator("digit_score_events", digits.digits, "events", ["value"], oracles.DIGIT, oracles.digit("events", ["value"]))
indicator("outlier_rule_score_orders", lambda s: outliers.outliers(s, forest=False), "orders", ["o_totalprice"], oracles.OUTLIER, oracles.outlier("orders", ["o_totalprice"]))
indicator("outlier_rule_score_lineitem", lambda s: outliers.outliers(s, forest=False), "lineitem", LINE, oracles.OUTLIER, oracles.outlier("lineitem", LINE))
indicator("smooth_score_orders_in_blocks", smoothness.smoothness, "orders", ["o_totalprice"], oracles.SMOOTH, oracles.smooth("orders", ["o_totalprice"]), SMALL)
indicator("ts_score_orders_in_blocks", timeseries.timeseries, "orders", ["o_totalprice"], oracles.TIMESERIES, oracles.timeseries("orders", ["o_totalprice"]), SMALL)
indicator("outlier_rule_score_orders_in_blocks", lambda s: outliers.outliers(s, forest=False), "orders", ["o_totalprice"], oracles.OUTLIER, oracles.outlier("orders", ["o_totalprice"]), SMALL)
indicator("drift_score_events_in_blocks", drift.drift, "events", ["value"], oracles.DRIFT, oracles.drift("events", ["value"]), SMALL)
indicator("cp_score_events_in_blocks", changepoint.changepoint, "events", ["value"], oracles.CHANGEPOINT, oracles.changepoint("events", ["value"]), SMALL)


@query("outlier_forest_events")
def outlier_forest_events(spark: SparkSession, d: str) -> DataFrame:
    return flat(outliers.outliers(series(spark, d, "events", ["value"])), ["isolation_forest_rate", "combined_outlier_rate"])


@query("page_hinkley_events", oracles.page_hinkley("events", ["value"]))
def page_hinkley_events(spark: SparkSession, d: str) -> DataFrame:
    rows = changepoint.features(series(spark, d, "events", ["value"]))
    return rows.select("i", F.round("cusum", 4).alias("cusum"), F.round("ph_stat", 4).alias("ph_stat"))


def profiled(name: str, of: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = profile.profile(table(spark, d, of), exact=True)
        rows = [(s.column, s.rows, s.present, s.numeric, s.distinct, s.column == found.time, s.column in found.numeric, round(found.missing_rate, 6)) for s in found.stats]
        return spark.createDataFrame(rows, "column string, n_rows long, present long, numeric long, n_distinct long, is_time boolean, is_numeric boolean, missing_rate double")


profiled("profile_lineitem", "lineitem", oracles.profile("lineitem", "l_shipdate", {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 0}))
profiled("profile_orders", "orders", oracles.profile("orders", "o_orderdate", {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": 0, "o_totalprice": 1, "o_orderdate": 0, "o_orderpriority": 0}))
profiled("profile_customer", "customer", oracles.profile("customer", None, {"c_custkey": 1, "c_name": 0, "c_nationkey": 1, "c_acctbal": 1, "c_mktsegment": 0}))


@query("screening_roles_events", oracles.SCREENING)
def screening_roles_events(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    return profile.screening(df, profile.profile(df, exact=True)).select("column", "role", "entered_analysis", "non_null_count", "unique_count", F.round("missing_rate", 6).alias("missing_rate"))


@query("screening_table_events", oracles.SCREENING_TABLE)
def screening_table_events(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    return profile.screening_table(profile.screening(df, profile.profile(df, exact=True)))


@query("prepare_preview30", oracles.PREVIEW)
def prepare_preview30(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    return profile.preview(df, profile.profile(df), ["event_id"]).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type", F.round("value", 6).alias("value"))


@query("union_by_name_acctbal", oracles.UNION)
def union_by_name_acctbal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return union_by_name([c, s]).groupBy("nationkey").agg(F.count("*").alias("n"), F.count("segment").alias("n_segment"), F.round(F.sum("acctbal"), 4).alias("acctbal"))


@query("sheet_jaccard", oracles.JACCARD)
def sheet_jaccard(spark: SparkSession, d: str) -> DataFrame:
    short = lambda n: {c.split("_", 1)[1] for c in table(spark, d, n).columns}
    sets = {n: short(n) for n in ("customer", "supplier", "nation")}
    rows = [(a, b, round(jaccard(sets[a], sets[b]), 6), sheet_strategy([sets[a], sets[b]])) for a, b in (("customer", "supplier"), ("customer", "nation"), ("supplier", "nation"))]
    return spark.createDataFrame(rows, "a string, b string, jaccard double, strategy string")


@query("sampling_score_events", oracles.sampling("events", "ts"))
def sampling_score_events(spark: SparkSession, d: str) -> DataFrame:
    return flat(sampling.sampling(table(spark, d, "events"), "ts"), oracles.SAMPLING)


@query("sampling_score_lineitem", oracles.sampling("lineitem", "l_shipdate"))
def sampling_score_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return flat(sampling.sampling(table(spark, d, "lineitem"), "l_shipdate"), oracles.SAMPLING)


@query("physical_rules_pest_lineitem", oracles.PHYSICAL)
def physical_rules_pest_lineitem(spark: SparkSession, d: str) -> DataFrame:
    found = physical.checks(table(spark, d, "lineitem"), LINE, "pest")
    return found.select("column", "rule", "lo", "hi", *[F.round(c, 6).alias(c) for c in ("hard_rate", "soft_rate", "hard_penalty", "soft_penalty", "unit_penalty")])


@query("physical_coverage_orders", oracles.COVERAGE)
def physical_coverage_orders(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    return flat(physical.physical(df, profile.profile(df).numeric), ["matched_rule_count", "rule_coverage", "coverage_penalty"])


@query("correlation_pairs_lineitem", oracles.pairs("lineitem", LINE))
def correlation_pairs_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return correlation.pair_table(table(spark, d, "lineitem"), LINE).select("left", "right", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("corr_score_part", oracles.corr_score("part", ["p_partkey", "p_size", "p_retailprice"]))
def corr_score_part(spark: SparkSession, d: str) -> DataFrame:
    return flat(correlation.correlation(table(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"]), oracles.CORRELATION)


@query("ml_robust_scale_lineitem", oracles.robust("lineitem", LINE))
def ml_robust_scale_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*[F.col(c).cast("double") for c in LINE])
    scaled = anomaly.robust_scale(rows, LINE)
    return scaled.agg(*[F.round(f(c), 6).alias(f"{c}_{k}") for c in LINE for k, f in (("mean", F.avg), ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))])


@query("ml_consensus_lineitem")
def ml_consensus_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return flat(anomaly.anomaly(table(spark, d, "lineitem"), LINE), list(anomaly.METRICS))


@query("weights_by_scenario", oracles.WEIGHTS)
def weights_by_scenario(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s, n, w) for s in config.SCENARIOS for n, w in config.weights(config.CORE, s).items()]
    return spark.createDataFrame(rows, "scenario string, indicator string, weight double")


@query("guardrail_cases", oracles.GUARD)
def guardrail_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = spark.createDataFrame([(34.9, 80.0), (34.9, 59.0), (35.0, 80.0), (49.9, 80.0), (49.9, 65.0), (50.0, 80.0), (None, 80.0)], "core double, raw_total_score double")
    return scoring.guarded(cases).select("core", "raw_total_score", "total_score", "risk_level")


@query("top_reasons_events")
def top_reasons_events(spark: SparkSession, d: str) -> DataFrame:
    df = with_rows(table(spark, d, "events"))
    found = profile.profile(df)
    return scoring.top_reasons(indicator_results(df, found, ["smoothness", "digit", "physical", "sampling"], "auto"))


@query("analysis_events")
def analysis_events(spark: SparkSession, d: str) -> DataFrame:
    """The whole way of one table: profile, all indicators but the models, weights, total with its guardrail, first reason."""
    found = analyze(table(spark, d, "events"), "auto", [n for n in config.ALL if n != "ml_anomaly"])
    rows = [(n, s, found.weights[n], found.total["raw_total_score"], found.total["total_score"], found.total["risk_level"], found.reasons[0]) for n, s in found.sub_scores.items()]
    return spark.createDataFrame(rows, "indicator string, score double, weight double, raw_total_score double, total_score double, risk_level string, first_reason string")


@query("sheet_drift_rollup", oracles.DRIFT_ROLLUP)
def sheet_drift_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Event types as sheets: a series of each sheet's values in one plan, its drift score, and the scores weighted by rows."""
    df = table(spark, d, "events")
    types = sorted(r["event_type"] for r in df.select("event_type").distinct().collect())  # a row a sheet
    wide = df.select(*ORDER["events"], *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in types])
    scores = drift.drift(ordered(wide, types, ORDER["events"])).select(F.col("column").alias("sheet"), "score")
    rows = df.groupBy(F.col("event_type").alias("sheet")).agg(F.count("*").alias("rows"))
    return scoring.roll_up(rows.join(scores, "sheet").withColumn("indicator", F.lit("drift")))


@query("matched_rules_lineitem", oracles.MATCHED)
def matched_rules_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """What the rules say of each column, with bounds, extremes and shares outside."""
    df = table(spark, d, "lineitem").withColumnsRenamed({"l_quantity": "rainfall", "l_extendedprice": "leaf_temperature", "l_discount": "soil_moisture", "l_tax": "co2"})
    found = physical.matched_rules(df, ["rainfall", "leaf_temperature", "soil_moisture", "co2"])
    return found.select("column", "rule", "soft_min", "soft_max", "hard_min", "hard_max", "min", "max", "hard_out_of_range_rate", "soft_out_of_range_rate", F.size("notes").alias("notes"))


@query("sheet_weighted_rollup", oracles.ROLLUP)
def sheet_weighted_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Event types as sheets: each sheet's rule scores, weighted by its rows."""
    df = table(spark, d, "events")
    rows = df.groupBy(F.col("event_type").alias("sheet")).agg(F.count("*").alias("rows"), (100 * F.avg((F.col("value") > 20).cast("double"))).alias("score"))
    return scoring.roll_up(rows.withColumn("indicator", F.lit("share_over_20")))


@query("total_score_events", oracles.total("events", "value", "ts"))
def total_score_events(spark: SparkSession, d: str) -> DataFrame:
    """The weighted total over indicators that SQL can say: smoothness, digits, time-series nature and drift."""
    s = series(spark, d, "events", ["value"])
    names = ["smoothness", "digit", "timeseries", "drift"]
    parts = [f(s) for f in (smoothness.smoothness, digits.digits, timeseries.timeseries, drift.drift)]
    results = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return scoring.total(scoring.sub_scores(results, names), config.weights(names)).select("raw_total_score", "core", "total_score", "risk_level")


@query("windowed_checks_events", oracles.WINDOWED)
def windowed_checks_events(spark: SparkSession, d: str) -> DataFrame:
    found = windowed_checks(table(spark, d, "events"), "ts", "value", "1 day")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "lo", "hi")
