from __future__ import annotations

import random

import numpy as np
import pytest

from credlens.functions import tables
from credlens.operators import anomaly, changepoint, digits, drift, ordered, outliers, smoothness, timeseries

from .test_indicators import frame


@pytest.fixture
def labels(monkeypatch):
    """Of the tables that are written."""
    found = []

    def written(df, label, **options):
        found.append(label)
        return tables.written(df, label, **options)

    monkeypatch.setattr(ordered, "written", written)
    return found


def blocked(spark, n=300, block=64):
    r = random.Random(3)
    a, b = np.cumsum([r.gauss(0, 1) for _ in range(n)]).tolist(), [float(r.randint(0, 9)) for _ in range(n)]
    return ordered.ordered(frame(spark, a=a, b=[None if k % 5 == 0 else x for k, x in enumerate(b)]), ["a", "b"], ["i"], block), {"a": a, "b": [x for k, x in enumerate(b) if k % 5]}


@pytest.mark.parametrize("run", [smoothness.smoothness, drift.drift, changepoint.changepoint, timeseries.timeseries])
def test_values_move_once(spark, labels, run):
    series, _ = blocked(spark)
    assert {r["column"] for r in run(series).collect()} == {"a", "b"}
    assert labels == ["pieces", "starts"]


def test_pieces_know_what_is_around_them(spark):
    """Also where partitions have fewer values than a piece reaches over."""
    for n, block in ((300, 32), (30, 8)):
        series, values = blocked(spark, n, block)
        series = ordered.Ordered(series.df.repartition(7), series.columns, series.order, series.stats, series.block)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = series.pieces.collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sum(len(r["x"]) // 8 for r in found) == sum(map(len, values.values())) and len(found) > 2 * len(values)
        for r in found:
            x, v, at = np.frombuffer(r["x"]), values[r["series"]], r["at"]
            assert x.tolist() == v[at : at + len(x)]
            assert ordered.unpacked(r["before"]).tolist() == v[max(0, at - ordered.HALO) : at]
            assert ordered.unpacked(r["after"]).tolist() == v[at + len(x) : at + len(x) + ordered.HALO]


def test_ranked_counts_only_what_is_near(spark, labels):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=3000), np.zeros(500), np.full(300, 2.5)])
    values = frame(spark, x=x.tolist()).selectExpr("'a' series", "x")
    for share, (q, below, total) in zip((0.0, 0.2, 0.5, 1.0), ordered.ranked(values, "x", [0.0, 0.2, 0.5, 1.0])["a"], strict=True):
        assert q == pytest.approx(np.quantile(x, share)) and below == (x < q).sum() and total == len(x)
    assert labels == []


@pytest.mark.parametrize("run", [digits.digits, lambda s: outliers.outliers(s, forest=False)])
def test_what_needs_no_order_is_not_ordered(spark, labels, run):
    assert len(run(blocked(spark)[0]).collect()) == 2
    assert labels == []


def test_robust_scale_counts_rows_itself(spark, monkeypatch):
    asked = []
    quantiles = anomaly.column_quantiles
    monkeypatch.setattr(anomaly, "column_quantiles", lambda *a: asked.append(a[1]) or quantiles(*a))
    a, b = [float(k * k % 101) for k in range(200)], [None if k % 4 == 0 else float(k % 17) for k in range(200)]
    found = [tuple(r) for r in anomaly.robust_scale(frame(spark, a=a, b=b).select("a", "b"), ["a", "b"], block=50).collect()]
    assert asked == [["a", "b"], ["b"]]  # quartiles move where gaps are filled
    filled = [np.array(a), np.array([np.median([x for x in b if x is not None]) if x is None else x for x in b])]
    want = np.column_stack([(v - np.median(v)) / (np.quantile(v, 0.75) - np.quantile(v, 0.25)) for v in filled])
    assert np.array(found) == pytest.approx(want)
