"""The SVM is fitted to the rows near its margin, however they were guessed, and is that of all rows; what 32 bits tell is never wrong."""

from __future__ import annotations

import numpy as np
import pytest

from credlens.operators import neighbours, support
from credlens.operators.forest import fit_svm, squared_distances

from .test_whole_models import counted, rows


@pytest.mark.parametrize(("margin", "start"), [(60, "any"), (150, "any"), (60, "middle"), (60, "side")])
def test_svm_of_rows_near_the_margin_is_that_of_all(spark, monkeypatch, margin, start):
    """Models of more and more rows (60), and first models of rows that are like no others."""
    monkeypatch.setattr(support, "MARGIN", margin)
    monkeypatch.setattr(support, "MORE", 2, raising=False)
    x, nu = rows(5), 0.05
    first = {"any": np.random.default_rng(0).permutation(x), "middle": x[np.argsort(np.abs(x - 3).sum(1))], "side": x[np.argsort(x[:, 0])]}[start]
    found = support.fit(counted(spark, x), ["x0", "x1"], len(x), nu, first[:margin])
    model = fit_svm(x, nu, steps=200_000)
    want = model[4] - model[2]
    assert found.distances(x) == pytest.approx(want, abs=2e-5)
    sure = np.abs(want + 1e-5) > 2e-5
    assert (found.below(x, -1e-5) == (want < -1e-5))[sure].all()


def test_rows_that_a_model_does_not_know_inside(spark):
    """All that are below a limit, and of the others those that the solution hasn't inside."""
    r = np.random.default_rng(6)
    x = np.unique(r.normal(size=(600, 2)), axis=0)
    basis = support.Basis(x[:1], np.ones((1, 1)), 0.5).grown(x)
    f = basis.features(x)
    models = [support.solved(y, np.full(len(y), 1 / (nu * len(y))), np.zeros(f.shape[1]), 1.0, y.mean(0), 1e-4) for y, nu in ((f[::3], 0.02), (f, 0.05))]
    one, last = (support.svm_of(basis, w, rho, x[:500], 0.001) for w, rho in models)
    found = lambda *given: {(a["x0"], a["x1"]) for a in support.looked(counted(spark, x), *given).collect()}
    limit = float(np.quantile(one.distances(x), 0.3))
    near = one.distances(x) < limit
    same = found([(one, limit)]) == set(map(tuple, x[near]))
    assert same and 0.2 < near.mean() < 0.4
    left = (last.distances(x) < support.NEAR**0.5) & ~near
    same = found([(one, limit)], last) == set(map(tuple, x[left]))
    assert same and left.any()


def test_rows_below_a_limit():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(6000, 3)), r.normal(size=(40, 3)) * 30, [[1e20, 0, 1], [1e100, -1e90, 0], [3e18, 3e18, 3e18]]])
    basis = support.Basis(x[:1], np.ones((1, 1)), 0.3).grown(x[:2000])
    f = basis.features(x[:2000])
    w, rho = support.solved(f, np.full(2000, 1 / 40), np.zeros(f.shape[1]), 1.0, f.mean(0))
    svm = support.svm_of(basis, w, rho, x[:500], 0.002)
    assert len(svm.first) < len(svm.rows)
    for limit in (-0.01, -1e-5, 0.0, 0.002, 0.05):
        assert (svm.below(x, limit) == (svm.distances(x) < limit)).all()


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e22])
def test_rows_within_are_never_left_out(scale):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(1500, 3)), r.normal(size=(300, 3)) * 1e-7 + 2, r.integers(0, 3, (200, 3)), r.normal(size=(4, 3)) * 1e9]) * scale
    x = np.unique(x, axis=0)
    x = x[np.lexsort(x.T)]
    d = squared_distances(x, x)
    last = np.partition(d, 9, 1)[:, 9]
    i, j = neighbours.within(x, x, last)
    got = np.zeros(d.shape, bool)
    got[i, j] = True
    assert got[d <= last[:, None]].all()
    near, squares = neighbours.nearest_copies(x, np.ones(len(x), int), np.arange(len(x)), 9)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1, kind="stable")[:, :9]
    assert (near == want).all() and (squares == np.take_along_axis(d, want, 1)).all()
