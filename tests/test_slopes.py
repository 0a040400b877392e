"""Selected slopes against all pairs."""

import math

import numpy as np
import pytest

from quakeloom.operators import slopes, stats


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))


def plain(x, y):
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    s = np.sort(((y[j] - y[i])[ok]) / ((x[j] - x[i])[ok]))
    n, nt = len(x), len(s)
    tie = lambda v: sum(k * (k - 1) * (2 * k + 5) for k in np.unique(v, return_counts=True)[1].tolist())
    sigma, z = math.sqrt((n * (n - 1) * (2 * n + 5) - tie(x) - tie(y)) / 18), 1.959963984540054
    at = [max(0, min(nt - 1, k)) for k in (round((nt - z * sigma) / 2), round((nt + z * sigma) / 2) - 1)]
    m = np.median(s)
    return m, np.median(y) - m * np.median(x), s[at[0]], s[at[1]]


@pytest.mark.parametrize(("kind", "block"), [("smooth", 4096), ("smooth", 20), ("rounded", 4096), ("rounded", 15), ("flat", 25), ("repeated", 8)])
def test_equals_all_pairs(spark, monkeypatch, kind, block):
    """Small blocks make several of them; rounded values tie in x, in y and in slopes, and a third of all points has one x."""
    monkeypatch.setattr(slopes, "BLOCK", block)
    rng = np.random.default_rng(len(kind) + block)
    x = rng.uniform(0, 5, 150)
    y = 1.7 * x + rng.normal(0, 1, 150)
    if kind != "smooth":
        x, y = np.round(x, 1), np.round(y, 1)
        x[:50] = 2.5
    if kind == "flat":
        y = np.where(rng.uniform(size=150) < 0.9, 3.0, y)
    if kind == "repeated":
        x, y = np.tile(x[:30], 5), np.tile(y[:30], 5)
        x[0] += 1
    rows = list(zip(x.tolist(), y.tolist())) + [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("inf"))]
    got = stats.theil_sen(spark.createDataFrame(rows, "x double, y double").repartition(4), "x", "y").first()
    assert [got[c] for c in ("slope", "intercept", "low", "high")] == pytest.approx(plain(x, y), rel=1e-9, abs=1e-9)


def test_too_few_points(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 5.0)]):
        assert stats.theil_sen(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["slope"] is None


def test_inversions_equal_nested_loops():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 33):
        z, w = rng.integers(0, 6, n).astype(float), rng.integers(1, 4, n)
        g = np.sort(rng.integers(0, 4, n))
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if z[j] <= z[i]]
        assert slopes.inversions(z, w) == sum(w[i] * w[j] for i, j in pairs)
        assert slopes.inversions(z, w, g) == sum(w[i] * w[j] for i, j in pairs if g[i] != g[j])


def test_places_apart_by_the_last_bits(spark, monkeypatch):
    """Means of copies differ in their last bits: slopes between them are right only if y - theta x is compared beyond its rounding."""
    monkeypatch.setattr(slopes, "BLOCK", 40)
    rng = np.random.default_rng(8)
    x, y = rng.uniform(4, 5, 60), rng.normal(29, 2, 60)
    x = np.concatenate([x, np.nextafter(x, 9), x])
    y = np.concatenate([y, np.nextafter(y, 99), y + 0.25])
    got = stats.theil_sen(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y").first()
    assert [got[c] for c in ("slope", "intercept", "low", "high")] == pytest.approx(plain(x, y), rel=1e-9)
