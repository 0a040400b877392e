"""Greedy de-duplication of one long session without a gap: slices of time give the walk's result in few rounds."""

import random

import pandas as pd
import pytest

from quakeloom.operators import relational


@pytest.mark.parametrize("length", [1, 16])
def test_slices_equal_the_walk(spark, monkeypatch, length):
    calls, real = [], relational.cut
    monkeypatch.setattr(relational, "cut", lambda df: calls.append(1) or real(df))
    monkeypatch.setattr(relational, "SLICE_LENGTH", length)
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(3000)) / 2, 45 + rng.random() * 6, -125 + rng.random() * 6) for i in range(2500)]
    df = pd.DataFrame(rows, columns=["id", "time_s", "lat", "lon"]).sort_values(["time_s", "lat", "lon", "id"], ignore_index=True)
    want = set(df.loc[relational.greedy_walk(df, 30, 250), "id"])
    got = relational.dedupe_events(spark.createDataFrame(rows, "id long, time_s double, lat double, lon double"), 30, 250, max_session=100)
    assert {r["id"] for r in got.collect()} == want
    assert length == 1 or len(calls) < 40  # each round on conflict pairs decides few events of a chain
