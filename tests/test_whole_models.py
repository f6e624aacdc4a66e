"""Neighbours and the SVM of a table are those of all its rows, over however many leaves and passes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from credlens.operators import anomaly, neighbours, support
from credlens.operators.forest import fit_svm, grow_forest, outlier_factors

from .test_indicators import frame, one


def rows(seed: int) -> np.ndarray:
    """Rows close together and far out, on a lattice (many at the same distance), and repeated."""
    r = np.random.default_rng(seed)
    lattice = np.column_stack([r.integers(0, 12, 900), r.integers(0, 9, 900) / 4]).astype(float)
    return np.concatenate([r.normal(3, 1, (1500, 2)), lattice, np.full((60, 2), 2.5), r.normal(0, 1, (30, 2)) * [40, 15], [[-90.0, 70.0], [0.0, -0.0]]])


def counted(spark, x: np.ndarray):
    return frame(spark, x0=x[:, 0].tolist(), x1=x[:, 1].tolist()).groupBy("x0", "x1").agg(F.count("*").alias("n")).repartition(5).localCheckpoint()


@pytest.mark.parametrize("leaf", [60, 10_000])
def test_outlier_factors_over_leaves_are_those_of_all_rows(spark, monkeypatch, leaf):
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    x = rows(1)
    x = x[np.lexsort(x.T)]
    want = {}
    for row, factor in zip(map(tuple, x), outlier_factors(x, 20), strict=True):
        want.setdefault(row, []).append(factor)
    df = counted(spark, x)
    tree = neighbours.tree_of(df, ["x0", "x1"], len(want))
    assert (tree.leaf >= 0).sum() > 20 if leaf == 60 else (tree.leaf >= 0).sum() == 1
    found = neighbours.factors(df, ["x0", "x1"], 20, tree, ["x0", "x1", "n"]).collect()
    assert len(found) == len(want) and sum(r["n"] for r in found) == len(x)
    for r in found:
        assert want[r["x0"], r["x1"]] == pytest.approx([r["factor"]] * r["n"], rel=1e-12)


def test_nearest_copies():
    r = np.random.default_rng(7)
    x = np.unique(np.concatenate([r.normal(size=(300, 3)), r.integers(0, 4, (60, 3)), r.normal(size=(5, 3)) * 30]), axis=0)
    x = x[np.lexsort(x.T)]
    copies = np.where(r.random(len(x)) < 0.2, r.integers(1, 9, len(x)), 1)
    every, owner = np.repeat(x, copies, 0), np.repeat(np.arange(len(x)), copies)
    d = sum((every[:, None, j] - every[None, :, j]) ** 2 for j in range(3))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, :12]
    first = np.cumsum(copies) - copies
    found = neighbours.nearest_copies(x, copies, np.arange(len(x)), 12)
    assert (found[0] == owner[near[first]]).all() and (found[1] == np.take_along_axis(d, near, 1)[first]).all()
    few = neighbours.nearest_copies(x[:3], np.array([1, 2, 1]), np.array([0, 1]), 12)
    assert (few[0] >= 0).sum(1).tolist() == [3, 3] and np.isinf(few[1][:, -1]).all()


@pytest.mark.parametrize("margin", [200, 10_000])
def test_svm_is_fitted_to_all_rows(spark, monkeypatch, margin):
    monkeypatch.setattr(support, "MARGIN", margin)  # rows that the driver solves for at once
    x = rows(2)
    nu = 0.05
    model = fit_svm(x, nu, steps=200_000)
    start = np.random.default_rng(0).permutation(x)[:400]
    found = support.fit(counted(spark, x), ["x0", "x1"], len(x), nu, start)
    assert found.distances(x) == pytest.approx(model[4] - model[2], abs=2e-5)
    far = support.Basis(start[:1], np.ones((1, 1)), model[3]).grown(x)
    assert len(far.beyond(x)) == 0 and (1 - (far.features(x) ** 2).sum(1)).max() <= support.NEAR


def test_anomaly_takes_its_models_from_all_rows(spark):
    """Shares over all rows, as models that are fitted to all of them give them."""
    x = rows(3)
    found = one(anomaly.anomaly(frame(spark, a=x[:, 0].tolist(), b=x[:, 1].tolist()), ["a", "b"]))["(table)"]["metrics"]
    scaled = (x - np.median(x, 0)) / (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0))
    model = fit_svm(scaled, 0.02, steps=200_000)
    assert found["rows"] == len(x)
    assert found["svm_rate"] == pytest.approx((model[4] - model[2] < -1e-5).mean(), abs=1.5 / len(x))
    factors = -outlier_factors(scaled[np.lexsort(scaled.T)], 20)
    assert found["factor_rate"] == pytest.approx((factors < np.percentile(factors, 2)).mean(), abs=1.5 / len(x))


def test_trees_draw_from_all_rows():
    """Rows that are dealt to trees: each tree is that of its own rows."""
    x = np.random.default_rng(4).normal(size=(3 * 256, 2)) + np.repeat([[0.0, 0], [100, 0], [0, 900]], 256, 0)
    cuts = grow_forest(x, 3, dealt=True).cuts
    assert [round(float(np.abs(c[0])), -2) for c in cuts] != [0, 0, 0] and np.isfinite(cuts[:, 0]).all()
    for t in range(3):
        part = x[t * 256 : (t + 1) * 256]
        assert part.min() <= cuts[t, 0] <= part.max()
