"""First arrivals against closed forms, a fine search over ray parameters, and reciprocity."""

import math

import numpy as np
import pytest

from quakeloom.functions.rays import first_arrival, layers_of
from quakeloom.operators import associate


def one(x, source, receiver, tops, speeds):
    return float(first_arrival(np.array([x]), np.array([source]), np.array([receiver]), np.array(tops, float), np.array(speeds, float))[0])


def test_uniform_and_flat():
    assert one(30, 40, 0, [0], [5.0]) == pytest.approx(10)
    assert one(30, 0, 0, [0], [5.0]) == pytest.approx(6) and one(0, 7, -3, [0], [5.0]) == pytest.approx(2) and one(0, 4, 4, [0], [5.0]) == 0


def test_two_layers_equal_a_search_over_ray_parameters():
    """A source in the lower layer: the time that Snell's law gives for the ray that comes out at the right distance."""
    p = np.linspace(0, 1 / 7 - 1e-9, 2_000_001)
    x = 10 * 5 * p / np.sqrt(1 - (5 * p) ** 2) + 6 * 7 * p / np.sqrt(1 - (7 * p) ** 2)
    t = 10 / 5 / np.sqrt(1 - (5 * p) ** 2) + 6 / 7 / np.sqrt(1 - (7 * p) ** 2)
    for far in (0.5, 10.0, 40.0, 90.0):
        assert one(far, 16, 0, [0, 10], [5.0, 7.0]) == pytest.approx(float(np.interp(far, x, t)), rel=1e-5)


def test_head_wave_beyond_the_crossover():
    """Source and receiver at the surface over a faster half-space."""
    v1, v2, h = 5.0, 8.0, 30.0
    cross = 2 * h * math.sqrt((v2 + v1) / (v2 - v1))
    for x in (cross * 0.9, cross * 1.1, 400.0):
        head = x / v2 + 2 * h * math.sqrt(1 / v1**2 - 1 / v2**2)
        assert one(x, 0, 0, [0, h], [v1, v2]) == pytest.approx(min(x / v1, head))
    assert one(400, 0, 0, [0, h], [8.0, 5.0]) == pytest.approx(50)  # a slower layer carries none


def test_reciprocity_and_order():
    rng = np.random.default_rng(2)
    tops, speeds = np.array([0, 4, 12, 30.0]), np.array([4.5, 6.0, 5.5, 8.0])
    x, a, b = rng.uniform(0, 300, 500), rng.uniform(-2, 60, 500), rng.uniform(-2, 5, 500)
    t = first_arrival(x, a, b, tops, speeds)
    assert np.allclose(t, first_arrival(x, b, a, tops, speeds)) and (t >= np.hypot(x, a - b) / 8.0 - 1e-9).all() and (t <= np.hypot(x, a - b) / 4.5 + 1e-9).all()


def test_gradients_become_steps(spark):
    tops, speeds = layers_of([{"depth": 0.0, "vp": 5.0, "vp_grad": 0.1}, {"depth": 10.0, "vp": 7.0, "vp_grad": 0.0}], "vp")
    assert len(tops) == 21 and speeds[0] == pytest.approx(5.025) and speeds[-1] == 7
    down = float(first_arrival(np.zeros(1), np.full(1, 10.0), np.zeros(1), tops, speeds)[0])
    assert down == pytest.approx(math.log(6 / 5) / 0.1, rel=1e-5)  # the integral of 1 / (5 + 0.1 z)
    with pytest.raises(ValueError):
        layers_of([], "vp")
    st = spark.createDataFrame([("A", 45.0, 179.9, 500.0), ("B", 45.0, -179.0, None), ("C", 10.0, 0.0, 0.0)], "sta string, lat double, lon double, elevation double")
    nd = spark.createDataFrame([(1, 45.0, -179.9, 8.0)], "node int, lat double, lon double, depth double")
    v = spark.createDataFrame([(0.0, 6.0, 3.0)], "depth double, vp double, vs double")
    got = {(r["sta"], r["phase"]): r["tt"] for r in associate.travel_times(st, nd, v, 100.0).collect()}
    assert set(got) == {("A", "P"), ("A", "S"), ("B", "P"), ("B", "S")} and got["A", "S"] == pytest.approx(2 * got["A", "P"])
