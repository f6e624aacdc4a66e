from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from credlens.operators import correlation, forest

from .test_indicators import frame


@pytest.mark.parametrize("often", [4, 1 << 12])
def test_frequent_values_stay_with_their_rows(spark, monkeypatch, often):
    """Ranks of values that many rows share go to the rows; only rows of rare values meet theirs in a shuffle."""
    monkeypatch.setattr(correlation, "OFTEN", often)
    met, whole = [], correlation.class_ranks

    def class_ranks(values, codes, k):
        met.append(whole(values, codes, k))
        return met[-1]

    monkeypatch.setattr(correlation, "class_ranks", class_ranks)
    r = np.random.default_rng(1)
    data = pd.DataFrame({"a": np.where(r.random(400) < 0.9, 1.0, r.normal(size=400)), "b": r.normal(size=400), "c": r.integers(0, 3, 400).astype(float)})
    found = correlation.spearman_table(frame(spark, **{c: data[c].tolist() for c in data}), list(data), "rho").where("left <> right").collect()
    for p in found:
        assert p["rho"] == pytest.approx(data[[p["left"], p["right"]]].corr(method="spearman").iloc[0, 1])
    counts = {(x["series"], x["x"]): x["often"] for x in met[0].collect()}
    assert counts[0, 1.0] == (data["a"] == 1).sum() and counts[2, 2.0] == (data["c"] == 2).sum() and len(counts) == data["a"].nunique() + 400 + 3


def test_neighbours_are_looked_for_in_small_batches(monkeypatch):
    sizes, nearest = [], forest.nearest
    monkeypatch.setattr(forest, "nearest", lambda x, y, k, skip: sizes.append(len(y)) or nearest(x, y, k, skip))
    r = np.random.default_rng(2)
    x, y = r.normal(size=(200, 3)), r.normal(size=(3000, 3))
    model, none = forest.fit_neighbours(x, 12), np.zeros(3000, bool)
    found = forest.outlier_factors_of(model, y, none)
    assert max(sizes) <= 1024 and sum(sizes) == 3000
    assert found[:5] == pytest.approx(forest.outlier_factors_of(model, y[:5], none[:5]))
