"""The distributed inversion against dense least squares with the same damping and gauge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import inversion, magnitude


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))


def observations(seed, events=60, stations=25, outliers=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(events):
        for s in rng.choice(stations, rng.integers(2, 9), replace=False):
            for p in "PS"[: rng.integers(1, 3)]:
                rows.append((int(e), f"N.{s}", p, float(rng.uniform(0, 300)), float(rng.normal() - 0.001 * e)))
    rows += rows[:5]  # repeated measurements count twice
    for i in range(outliers):
        rows[i * 7] = (*rows[i * 7][:4], 40.0)
    return rows


def dense(rows, damp, gauge_w, fix_n):
    events, terms = sorted({r[0] for r in rows}), sorted({r[1:3] for r in rows})
    slopes = [(k, p) for p in "PS" for k in ("nk" if fix_n is None else "k")]
    a, b = np.zeros((len(rows) + 2, len(events) + len(terms) + len(slopes))), np.zeros(len(rows) + 2)
    for o, (e, s, p, r, y) in enumerate(rows):
        r = max(r, 1e-3)
        a[o, events.index(e)] = a[o, len(events) + terms.index((s, p))] = 1
        for at, (k, q) in enumerate(slopes):
            if p == q:
                a[o, len(events) + len(terms) + at] = -np.log10(r / 100) if k == "n" else -r
        b[o] = y + (0 if fix_n is None else fix_n * np.log10(r / 100))
    for g, p in enumerate("PS"):
        for at, (_, q) in enumerate(terms):
            a[len(rows) + g, len(events) + at] = gauge_w * (p == q)
    x = np.linalg.lstsq(np.vstack([a, damp * np.eye(a.shape[1])]), np.concatenate([b, np.zeros(a.shape[1])]), rcond=None)[0]
    n, m = len(events), len(terms)
    return dict(zip(events, x)), dict(zip(terms, x[n : n + m])), {f"{k}|{p}": v for (k, p), v in zip(slopes, x[n + m :])}


SCHEMA = "event_id long, station string, phase string, dist_hypo_km double, log10A double"


@pytest.mark.parametrize(("seed", "damp", "fix_n", "heavy"), [(1, 1e-3, 1.0, 50_000), (2, 1e-2, None, 50_000), (3, 1e-3, 1.0, 9), (4, 0.1, None, 6)])
def test_equals_dense_least_squares(spark, monkeypatch, seed, damp, fix_n, heavy):
    monkeypatch.setattr(inversion, "HEAVY", heavy)  # 9 and 6: many events are solved for beside the stations
    rows = observations(seed)
    df = spark.createDataFrame([*rows, (None, "N.1", "P", 1.0, 1.0), (1, None, "P", 1.0, 1.0), (1, "N.1", "P", None, 1.0)], SCHEMA).repartition(5)
    mags, terms, coeffs = magnitude.invert_magnitudes(df, damp, 1000.0, fix_n)
    m, c, k = dense(rows, damp, 1000.0, fix_n)
    got = {r["event_id"]: r["M_rel"] for r in mags.collect()}
    assert got.keys() == m.keys() and all(abs(got[e] - v) < 1e-6 for e, v in m.items())
    own = {(r["station"], r["phase"]): r for r in terms.collect()}
    assert own.keys() == c.keys() and all(abs(own[t]["C"] - v) < 1e-6 for t, v in c.items())
    assert sum(r["n_obs"] for r in own.values()) == len(rows)
    assert all(abs(coeffs[n] - v) < 1e-7 for n, v in k.items())


def test_second_pass_leaves_out_outliers(spark):
    rows = observations(7, events=80, outliers=4)
    resid, terms, coeffs = magnitude.fit_magnitudes(spark.createDataFrame(rows, SCHEMA), fix_n=1.0)
    at = lambda rows, m, c, k: [y - (m[e] + c[s, p] - np.log10(max(r, 1e-3) / 100) - k[f"k|{p}"] * max(r, 1e-3)) for e, s, p, r, y in rows]
    first = np.array(at(rows, *dense(rows, 1e-3, 1000.0, 1.0)))
    mad = 1.4826 * np.median(np.abs(first - np.median(first)))
    kept = [r for r, x in zip(rows, first) if abs(x) <= 4 * mad]
    assert len(kept) < len(rows)
    m, c, k = dense(kept, 1e-3, 1000.0, 1.0)
    got = resid.select("event_id", "station", "phase", "log10A", "resid").collect()
    assert sorted(r[:4] for r in map(tuple, got)) == sorted((e, s, p, y) for e, s, p, _, y in kept)
    assert sorted(round(r["resid"], 5) for r in got) == sorted(round(x, 5) for x in at(kept, m, c, k))
    assert coeffs["n|P"] == 1.0


def test_no_observations(spark):
    mags, terms, coeffs = magnitude.invert_magnitudes(spark.createDataFrame([], SCHEMA))
    assert mags.count() == 0 and terms.count() == 0 and coeffs == {}


def test_a_step_moves_blocks_not_numbers(spark, monkeypatch):
    from quakeloom.operators import inversion, vectors

    rows = [(e, f"S{s:03d}", p, 10.0 + (e * 7 + s) % 50, 0.01 * ((e * s) % 97) - 1) for e in range(60) for s in range(e % 7, 200, 7) for p in "PS"]
    obs = spark.createDataFrame(rows, "event_id long, station string, phase string, dist_hypo_km double, log10A double")
    want = {r["event_id"]: r["M_rel"] for r in inversion.invert_magnitudes(obs)[0].collect()}
    monkeypatch.setattr(vectors, "BLOCK", 64)
    got = {r["event_id"]: r["M_rel"] for r in inversion.invert_magnitudes(obs)[0].collect()}
    assert want.keys() == got.keys() and all(abs(want[e] - got[e]) < 1e-7 for e in want)
    packed, system = inversion._system(obs, None, 1e-3)
    assert packed.count() <= packed.rdd.getNumPartitions() and system.size == 404
