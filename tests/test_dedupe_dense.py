"""Greedy de-duplication of events so dense that a walk never forgets how it began."""

import math
import random

import pandas as pd

from quakeloom.operators import relational


def plain_walk(rows, dt_s, dist_km):
    """Ids of kept rows, each compared with all kept ones before it."""
    kept = []
    for i, t, lat, lon in rows:
        a, o = math.radians(lat), math.radians(lon)
        near = lambda x: 2 * 6371.0 * math.asin(math.sqrt(min(1, math.sin((a - x[2]) / 2) ** 2 + math.cos(a) * math.cos(x[2]) * math.sin((o - x[3]) / 2) ** 2))) <= dist_km
        if not any(t - x[1] <= dt_s and near(x) for x in reversed(kept[-200:])):
            kept.append((i, t, a, o))
    return {x[0] for x in kept}


def frame(rows):
    return pd.DataFrame(rows, columns=["id", "time_s", "lat", "lon"])


def in_order(n, seconds, seed):
    rng = random.Random(seed)
    rows = [(i, 1.7e9 + rng.randrange(seconds * 4) / 4, 45 + rng.random() * 6, -125 + rng.random() * 6) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0]))


def test_the_walk_equals_plain_comparison():
    for n, seconds, dt in ((1500, 300, 30), (400, 4000, 10.25), (300, 20, 0)):
        rows = in_order(n, seconds, n)
        df = frame(rows)
        assert set(df.loc[relational.greedy_walk(df, dt, 250), "id"]) == plain_walk(rows, dt, 250)
    assert list(relational.greedy_walk(frame([]), 30, 250)) == []


def test_rounds_do_not_pass_over_all_events(spark, monkeypatch):
    calls, real = [], relational.cut
    monkeypatch.setattr(relational, "cut", lambda df: calls.append(1) or real(df))
    monkeypatch.setattr(relational, "SLICE_LENGTH", 1)
    rows = in_order(12_000, 1200, 5)
    got = relational.dedupe_events(spark.createDataFrame(frame(rows)), 30, 250, max_session=100)
    assert {r["id"] for r in got.collect()} == plain_walk(rows, 30, 250)
    assert len(calls) < 10  # every round wrote all kept events anew
