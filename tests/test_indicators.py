from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credlens.operators import anomaly, changepoint, correlation, digits, drift, outliers, physical, sampling, smoothness, timeseries
from credlens.operators.forest import _grow, fit_neighbours, fit_svm, grow_forest, isolation_scores, nearest, outlier_factors, outlier_factors_of, score_steps, svm_distances, svm_distances_of
from credlens.operators.ordered import cumulated, ordered, quantiles


def frame(spark, **columns):
    rows = list(zip(range(len(next(iter(columns.values())))), *columns.values(), strict=True))
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in columns))


def one(df):
    return {r["column"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def constant_step(spark):
    return ordered(frame(spark, a=[10 - 0.1 * k for k in range(40)], b=[5 + 0.5 * k for k in range(40)]), ["a", "b"], ["i"])


def test_constant_step(constant_step):
    for r in one(smoothness.smoothness(constant_step)).values():
        assert 40 <= r["score"] <= 52
    for r in one(timeseries.timeseries(constant_step)).values():
        assert r["score"] == pytest.approx(62, abs=0.5)
    for r in one(drift.drift(constant_step)).values():
        assert r["score"] == pytest.approx(28.3, abs=0.3)


def test_constant_series(spark):
    s = ordered(frame(spark, a=[3.0] * 40), ["a"], ["i"])
    r = one(smoothness.smoothness(s))["a"]
    assert r["metrics"]["normalized_mean_abs_diff"] == 0 and r["metrics"]["second_diff_penalty"] == 0
    assert one(timeseries.timeseries(s))["a"]["metrics"]["trend_strength"] is None
    assert one(digits.digits(s))["a"]["metrics"]["duplicate_rate"] == pytest.approx(1 - 1 / 40)
    assert one(changepoint.changepoint(s))["a"]["metrics"]["best_window_index"] is None
    for f in (drift.drift, outliers.outliers):
        assert 0 <= one(f(s))["a"]["score"] <= 100


@pytest.mark.parametrize("run, least, score", [(smoothness.smoothness, 8, 50), (digits.digits, 10, 50), (timeseries.timeseries, 12, 50), (outliers.outliers, 12, 50), (drift.drift, 20, 65), (changepoint.changepoint, 20, 65)])
def test_minimum(spark, run, least, score):
    r = random.Random(1)
    short = one(run(ordered(frame(spark, a=[r.random() for _ in range(least - 1)]), ["a"], ["i"])))["a"]
    assert short["score"] == score and short["metrics"] == {}
    assert one(run(ordered(frame(spark, a=[r.random() for _ in range(least)]), ["a"], ["i"])))["a"]["metrics"]


def test_gaps_and_nan_are_left_out(spark):
    values = [1.0, None, 4.0, float("nan"), 9.0, 16.0, 25.0, 36.0, 49.0, 64.0, 81.0]
    s = ordered(frame(spark, a=values), ["a"], ["i"])
    assert [r["x"] for r in s.rows.orderBy("i").collect()] == [1, 4, 9, 16, 25, 36, 49, 64, 81]


def test_blocks_agree_with_one_window(spark):
    r = random.Random(7)
    walk = np.cumsum([r.gauss(0, 1) for _ in range(400)]).round(3).tolist()
    df = frame(spark, a=walk, b=[round(r.random(), 1) for _ in range(400)])
    whole, blocked = ordered(df, ["a", "b"], ["i"]), ordered(df, ["a", "b"], ["i"], block=64)
    assert blocked.blocks > 1
    for f in (smoothness.smoothness, timeseries.timeseries, drift.drift, changepoint.changepoint, digits.digits, lambda s: outliers.outliers(s, forest=False)):
        x, y = one(f(whole)), one(f(blocked))
        for c in x:
            assert x[c]["score"] == pytest.approx(y[c]["score"])
            for m, v in x[c]["metrics"].items():
                assert y[c]["metrics"][m] is None if v is None else y[c]["metrics"][m] == pytest.approx(v, rel=1e-9, abs=1e-9), m
    q = {r["series"]: r for r in quantiles(blocked.rows, "x", [0.25, 0.75], blocked.counts, 64).collect()}
    assert q["a"]["q0"] == pytest.approx(np.quantile(walk, 0.25)) and q["a"]["q1"] == pytest.approx(np.quantile(walk, 0.75))


def test_ties_are_counted_before_they_are_ranked(spark):
    r = random.Random(11)
    a = [float(r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(300)]  # most rows have one value
    b = [x + r.choice([0.0, 1.0]) for x in a]
    holes = [None if k % 7 == 0 else x for k, x in enumerate(b)]
    df = frame(spark, a=a, b=b, c=holes)
    blocked = ordered(df, ["a", "b", "c"], ["i"], block=32)
    counts = {(c["series"], c["x"]): c for c in cumulated(blocked.rows.select("series", "x"), ["series"]).collect()}
    assert counts["a", 0.0]["m"] == a.count(0.0) and counts["a", 0.0]["start"] == 0 and counts["a", 2.0]["start"] == sum(x < 2 for x in a) and counts["b", 1.0]["total"] == 300
    q = {c["series"]: c for c in quantiles(blocked.rows, "x", [0.0, 0.1, 0.5, 0.9, 1.0], blocked.counts, 32).collect()}
    for name, values in (("a", a), ("b", b), ("c", [x for x in holes if x is not None])):
        assert [q[name][f"q{k}"] for k in range(5)] == pytest.approx(np.quantile(values, [0.0, 0.1, 0.5, 0.9, 1.0]).tolist())
    for columns in (["a", "b"], ["a", "b", "c"]):
        whole, split = ({(p["left"], p["right"]): p for p in correlation.pair_table(df, columns, block).collect()} for block in (1000, 32))
        assert whole.keys() == split.keys()
        for k, p in whole.items():
            assert split[k]["spearman"] == pytest.approx(p["spearman"]) and split[k]["pearson"] == pytest.approx(p["pearson"])
    assert quantiles(blocked.rows.limit(0), "x", [0.5], blocked.counts, 32).count() == 0


@pytest.mark.parametrize("shares", [{"a": 0.2, "d": 0.5}, dict.fromkeys("abcdef", 0.4)])
def test_correlations_under_patterns_of_nulls(spark, shares):
    """Few patterns of nulls, and more patterns than columns; ties, a constant column, an empty one."""
    r = np.random.default_rng(len(shares))
    n = 400
    data = {"a": r.normal(size=n), "b": r.integers(0, 5, n).astype(float), "c": r.normal(size=n) + 1e9, "d": r.normal(size=n), "e": np.full(n, 7.1), "f": r.integers(0, 40, n).astype(float), "g": np.full(n, np.nan)}
    data["d"] = data["a"] ** 3 + data["b"]
    for c, share in shares.items():
        data[c] = np.where(r.random(n) < share, np.nan, data[c])
    pdf = pd.DataFrame(data)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in pdf.to_numpy()], ", ".join(f"{c} double" for c in data))
    found = {(p["left"], p["right"]): p for p in correlation.pair_table(df.repartition(5), list(data)).collect()}
    assert len(found) == 21
    for (a, b), p in found.items():
        both = pdf[[a, b]].dropna()
        for name, method in (("pearson", "pearson"), ("spearman", "spearman")):
            want = both.corr(method=method).iloc[0, 1] if len(both) > 1 and "e" not in (a, b) else np.nan
            assert (p[name] is None) == bool(np.isnan(want)), (a, b, name, p[name], want)
            assert p[name] is None or p[name] == pytest.approx(want, abs=1e-6 if "c" in (a, b) else 1e-9)


def test_many_columns_in_two_scans(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 60)).cumsum(axis=1)
    columns = [f"c{k}" for k in range(60)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"{c} double" for c in columns))
    found = {(p["left"], p["right"]): p["value"] for p in correlation.heatmap(df, columns).collect()}
    want = np.corrcoef(x.T)
    pairs = correlation.pair_table(df.select(*columns[:25]), columns[:25]).collect()
    ranks = pd.DataFrame(x[:, :25]).corr(method="spearman").to_numpy()
    assert len(pairs) == 300 and all(p["spearman"] == pytest.approx(ranks[int(p["left"][1:]), int(p["right"][1:])], abs=1e-9) for p in pairs)
    assert len(found) == 3600 and all(found[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(60) for j in range(60))


def test_pairs_are_named(spark):
    df = spark.createDataFrame([(float(k), 3.0 * k, float(k * k % 17), -1.0 * k) for k in range(60)], "w double, x double, y double, z double")
    text = correlation.correlation(df, ["w", "x", "y", "z"]).first()["reasons"][0]["text"]
    assert [p for p in ("w-x: Pearson=1.000", "w-z: Pearson=-1.000", "x-z: Pearson=-1.000") if p in text] == ["w-x: Pearson=1.000", "w-z: Pearson=-1.000", "x-z: Pearson=-1.000"]


def test_heatmap(spark):
    df = frame(spark, a=[float(k) for k in range(20)], b=[float(-k) for k in range(20)], c=[1.0] * 20)
    cells = {(h["left"], h["right"]): h["value"] for h in correlation.heatmap(df, ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells["a", "a"] == pytest.approx(1) and cells["a", "b"] == cells["b", "a"] == pytest.approx(-1)
    assert cells["c", "c"] == cells["a", "c"] == cells["c", "a"] == 0


def test_page_hinkley_against_a_loop(spark):
    r = random.Random(3)
    x = [r.gauss(0, 1) + (3 if k > 30 else 0) for k in range(60)]
    rows = changepoint.features(ordered(frame(spark, a=x), ["a"], ["i"])).orderBy("i").collect()
    mean = total = low = 0.0
    for k, v in enumerate(x):
        mean += (v - mean) / (k + 1)
        total += v - mean - 0.005 * np.std(x)
        low = min(low, total)
        assert rows[k]["ph_stat"] == pytest.approx(total - low, abs=1e-9)


def test_step_is_a_change_point(spark):
    r = one(changepoint.changepoint(ordered(frame(spark, a=[0.0] * 30 + [10.0] * 30), ["a"], ["i"])))["a"]
    assert r["metrics"]["best_window_index"] == 30 and r["metrics"]["best_window_mean_shift_ratio"] == 1
    assert r["risk"] == "attention"


def test_digit_kinds(spark):
    n = 60
    cols = {"egg_count": [float(k % 50) for k in range(n)], "temperature": [20.0 + k % 5 for k in range(n)], "growth_rate": [k / 7 for k in range(n)], "plain": [float(k * 7) for k in range(n)], "neg": [float(-k) for k in range(n)]}
    kinds = {c: digits.KINDS[int(r["metrics"]["numeric_kind"])] for c, r in one(digits.digits(ordered(frame(spark, **cols), list(cols), ["i"]))).items()}
    assert kinds == {"egg_count": "count", "temperature": "rounded_measurement", "growth_rate": "rate_or_ratio", "plain": "discrete_integer", "neg": "continuous_or_unknown"}


def test_decimal_places(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (-2.25,), (1e-10,), (120.0,), (3.1400000001,)], "x double").select("x", digits.places(F.col("x")).alias("p"), digits.last_digit(F.col("x"), digits.places(F.col("x"))).alias("d"))
    assert [(r["p"], r["d"]) for r in df.collect()] == [(0, 1), (1, 5), (2, 5), (10, 1), (0, 0), (10, 1)]


def test_sampling(spark):
    times = [f"2026-01-01 {h:02d}:00:00" for h in (0, 1, 2, 3, 4, 18, 19, 20, 21, 22)] + ["2026-01-01 22:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("cast(t as timestamp) as t")
    r = one(sampling.sampling(df, "t"))["(table)"]
    assert r["metrics"]["break_count"] == 1 and r["metrics"]["longest_missing_run"] == 13
    assert r["metrics"]["duplicate_timestamp_ratio"] == pytest.approx(1 / 11)
    assert one(sampling.sampling(df, None))["(table)"]["score"] == 82
    assert one(sampling.sampling(df.limit(3), "t"))["(table)"]["score"] == 86
    assert one(sampling.sampling(df, "t", mismatch=0.5, skipped=2))["(table)"]["metrics"]["skipped_sheet_penalty"] == 6


def test_physical(spark):
    df = frame(spark, humidity=[120.0, 50.0, 60.0, 70.0], soil_moisture=[0.2, 0.3, 0.4, 0.5], residue=[-1.0, 1.0, 2.0, 3.0])
    r = {x["column"]: x for x in physical.checks(df, ["humidity", "soil_moisture", "residue"]).collect()}
    assert r["humidity"]["hard_rate"] == 0.25 and r["humidity"]["hard_penalty"] == 28
    assert r["soil_moisture"]["unit_penalty"] == 6 and r["residue"]["unit_penalty"] == 10
    told = [x["text"] for x in one(physical.physical(df, ["residue", "soil_moisture", "humidity"]))["(table)"]["reasons"]]
    assert [t.split(":")[0] for t in told] == [c for c in ("residue", "soil_moisture", "humidity") for n in physical.matched_rules(df, [c]).collect() for _ in n["notes"]] and told
    matched = {x["column"]: x for x in physical.matched_rules(df, ["humidity", "soil_moisture", "residue"]).collect()}
    assert (matched["residue"]["soft_max"], matched["residue"]["hard_max"]) == (50, 1000) and matched["humidity"]["hard_out_of_range_rate"] == pytest.approx(r["humidity"]["hard_rate"], abs=1e-4)
    total = one(physical.physical(df, ["humidity", "soil_moisture", "residue"]))["(table)"]
    assert total["score"] == pytest.approx(100 - 28 - 6 - 28 - 10)
    assert one(physical.physical(df.withColumnRenamed("humidity", "h"), ["h"]))["(table)"]["score"] == 92


def test_correlation(spark):
    r = random.Random(5)
    x = [r.random() for _ in range(80)]
    df = frame(spark, a=x, b=[2 * v for v in x], c=[r.random() if k % 4 else None for k in range(80)])
    pairs = {(p["left"], p["right"]): p for p in correlation.pair_table(df, ["a", "b", "c"]).collect()}
    assert pairs["a", "b"]["pearson"] == pytest.approx(1) and pairs["a", "b"]["spearman"] == pytest.approx(1)
    pdf = df.toPandas()[["a", "c"]].dropna()
    assert pairs["a", "c"]["pearson"] == pytest.approx(pdf.corr().iloc[0, 1])
    assert pairs["a", "c"]["spearman"] == pytest.approx(pdf.rank().corr().iloc[0, 1])
    assert one(correlation.correlation(df, ["a", "b", "c"]))["(table)"]["metrics"]["perfect_correlation_penalty"] == pytest.approx(35)
    assert one(correlation.correlation(df, ["a"]))["(table)"]["score"] == 70


def test_detectors():
    x = np.vstack([np.random.default_rng(0).normal(0, 1, (200, 2)), [[9, 9], [-8, 9], [10, -9]]])
    assert set(np.argsort(-isolation_scores(grow_forest(x, 100), x))[:3]) == {200, 201, 202}
    assert set(np.argsort(-outlier_factors(x, 15))[:3]) == {200, 201, 202}
    outside = svm_distances(x, 0.05) < 0
    assert 0.01 <= outside.mean() <= 0.12 and outside[200:].all()


def test_anomaly(spark):
    r = random.Random(2)
    df = frame(spark, a=[r.gauss(0, 1) for _ in range(120)], b=[r.gauss(0, 1) if k % 9 else None for k in range(120)], c=[1.0] * 120)
    found = one(anomaly.anomaly(df, ["a", "b", "c"]))["(table)"]
    assert found["metrics"]["rows"] == 120 and 0 <= found["score"] <= 100
    assert found["metrics"]["forest_rate"] == pytest.approx(8 / 120, abs=0.02)
    assert one(anomaly.anomaly(df.limit(19), ["a", "b"]))["(table)"]["score"] == 55
    assert one(anomaly.anomaly(df, ["a", "c"]))["(table)"]["score"] == 58


def test_anomaly_scores_all_rows(spark):
    r = random.Random(3)
    rows = [(5.0, 5.0)] * 2000 + [(r.gauss(0, 1), r.gauss(0, 1)) for _ in range(3950)] + [(40 + r.random(), -40 - r.random()) for _ in range(50)]
    r.shuffle(rows)
    df = frame(spark, a=[a for a, _ in rows], b=[b for _, b in rows])
    found = one(anomaly.anomaly(df, ["a", "b"]))["(table)"]["metrics"]
    assert found["rows"] == 6000
    assert found["forest_rate"] == found["factor_rate"] == pytest.approx(0.02, abs=1e-9)
    assert 50 / 6000 <= found["consensus_rate"] <= 0.04
    assert one(anomaly.anomaly(df.repartition(7), ["a", "b"]))["(table)"]["metrics"] == found
    counted = df.select(F.col("a").alias("x0"), F.col("b").alias("x1")).groupBy("x0", "x1").agg(F.count("*").alias("n"))
    sample = anomaly.sample_counts(counted, 2, 6000, 800)
    assert sum(sample.values()) == 800 and 210 <= sample[5.0, 5.0] <= 325  # a third of the rows
    scored = counted.withColumnRenamed("x0", "s")
    for share in (0.0, 0.02, 0.5, 0.9, 1.0):
        found = anomaly.score_limits(scored, ("s", "x1"), share, 6000)
        assert found == [pytest.approx(np.percentile([r[k] for r in rows], 100 * share), abs=1e-12) for k in (0, 1)]
    ranked, plain = (anomaly.robust_scale(df.select("a", "b"), ["a", "b"], 6000, block).agg(F.sum(F.abs("a")), F.sum(F.abs("b"))).first() for block in (1000, 10_000))
    assert ranked == pytest.approx(plain)


def test_fitted_models_agree_with_their_own_rows():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(150, 3)), np.ones((30, 3))])
    assert outlier_factors_of(fit_neighbours(x, 10), x, np.full(len(x), True)) == pytest.approx(outlier_factors(x, 10))
    assert svm_distances_of(fit_svm(x, 0.05), x) == pytest.approx(svm_distances(x, 0.05), abs=1e-9)


def test_forest_arrays_give_the_depths_of_the_trees():
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(400, 3)), np.ones((50, 3)), r.normal(size=(5, 3)) * 40])
    forest, random, size = grow_forest(x, 20), np.random.default_rng(42), 256

    def depth(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    trees = [_grow(x[random.choice(len(x), size, replace=False)], 0, 8, random) for _ in range(20)]
    want = [2 ** (-np.mean([depth(t, row) for t in trees]) / forest.usual) for row in x]
    assert isolation_scores(forest, x) == pytest.approx(want, abs=1e-12)
    one = grow_forest(x[:, :1], 30)
    ends, scores = score_steps(one)
    assert scores[np.searchsorted(ends, x[:, 0], side="left")] == pytest.approx(isolation_scores(one, x[:, :1]), abs=1e-12)
    assert isolation_scores(grow_forest(np.ones((5, 1)), 3), np.ones((2, 1))) == pytest.approx([0.5, 0.5], abs=0.2)


def test_nearest_rows_are_exact():
    r = np.random.default_rng(10)
    far = 1e7 + r.normal(size=(40, 2)) * 1e-3  # a cluster so far out that a product of matrices can't tell its rows apart
    x = np.concatenate([r.normal(size=(300, 2)), np.ones((60, 2)), far])
    for y, member in ((x, True), (np.concatenate([r.normal(size=(50, 2)), far + 1e-4]), False)):
        skip = np.full(len(y), member)
        near, distance = nearest(x, y, 10, skip)
        for i, row in enumerate(y):
            d = np.sqrt(((x - row) ** 2).sum(1))
            if member:
                d[i] = np.inf
            assert sorted(distance[i]) == pytest.approx(sorted(d)[:10], rel=1e-9, abs=1e-12)
            assert len(set(near[i].tolist())) == 10


def test_outlier_forest_threshold_counts_all_values(spark):
    """Every value far out is apart, however few of them the sample holds; the share is that of all values."""
    values = [float(k % 1000) for k in range(9000)] + [50_000.0 + k for k in range(100)]
    found = one(outliers.outliers(ordered(frame(spark, a=values), ["a"], ["i"])))["a"]
    assert found["metrics"]["isolation_forest_rate"] == pytest.approx(0.02, abs=0.003)


def test_outlier_forest_rate(spark):
    r = random.Random(4)
    found = one(outliers.outliers(ordered(frame(spark, a=[r.gauss(0, 1) for _ in range(300)]), ["a"], ["i"])))["a"]
    assert found["metrics"]["isolation_forest_rate"] == pytest.approx(0.02, abs=0.01)
    assert not math.isnan(found["score"])
