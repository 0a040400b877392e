"""The geodesic against published values, windows by phase case, coherence, files with a preamble."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quakeloom.functions import geo, signal
from quakeloom.functions.geodesic import inverse
from quakeloom.operators import match
from quakeloom.sources import readers

#: lat1, lon1, lat2, lon2, km, azimuth, back azimuth of the WGS84 ellipsoid.
PUBLISHED = [
    (40.6, -73.8, 51.6, -0.5, 5551.759400319, 51.198882845579, 287.821776735514),
    (0.0, 0.0, 45.0, 0.0, 4984.944377978, 0.0, 180.0),
    (0.0, 0.0, 90.0, 0.0, 10001.965729231, 0.0, 180.0),
    (0.0, 0.0, 0.0, 1.0, 111.319490793, 90.0, 270.0),
    (0.0, 179.5, 0.0, -179.5, 111.319490793, 90.0, 270.0),
]


def solve(spark, rows):
    df = spark.createDataFrame([(i, *map(float, r[:4])) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double")
    return [r["g"] for r in df.select("i", inverse("a", "b", "c", "d").alias("g")).orderBy("i").collect()]


def test_geodesic_of_published_pairs(spark):
    for g, want in zip(solve(spark, PUBLISHED), PUBLISHED):
        assert abs(g["km"] - want[4]) < 1e-3 and abs((g["az"] - want[5] + 180) % 360 - 180) < 1e-6 and abs((g["baz"] - want[6] + 180) % 360 - 180) < 1e-6
    back = solve(spark, [(c, d, a, b) for a, b, c, d, *_ in PUBLISHED])
    assert all(abs(g["km"] - w[4]) < 1e-3 and abs((g["az"] - w[6] + 180) % 360 - 180) < 1e-6 for g, w in zip(back, PUBLISHED))


def test_geodesic_of_awkward_pairs(spark):
    rows = [(5, 5, 5, 5), (0, 0, 0, 180), (0, 0, 0.5, 179.7), (90, 0, -90, 0), (89.9, 10, 89.9, -170)]
    got = solve(spark, rows)
    assert got[0]["km"] == 0 and all(math.isfinite(g[k]) for g in got for k in ("km", "az", "baz"))
    assert got[1]["km"] == pytest.approx(20003.93, rel=6e-3) and got[2]["km"] == pytest.approx(19936.29, rel=6e-3)
    assert spark.createDataFrame([(None, 1.0)], "a double, b double").select(inverse("a", "b", "b", "b").alias("g")).first()["g"] is None
    rng = random.Random(1)
    near = [(rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(300)]
    df = spark.createDataFrame(near, "a double, b double, c double, d double").withColumn("g", inverse("a", "b", "c", "d")).withColumn("s", geo.haversine_km("a", "b", "c", "d"))
    assert df.where(F.abs(F.col("g.km") / F.col("s") - 1) > 0.006).count() == 0


def test_windows_by_phase_case(spark):
    picks = spark.createDataFrame([("A", "P", 100.0), ("A", "P", 101.0), ("A", "S", 110.0), ("B", "P", 100.0), ("C", "S", 100.0), ("D", "X", 1.0), ("E", "P", None)], "k string, phase string, time_s double")
    got = {r["k"]: tuple(r)[1:] for r in signal.phase_windows(picks, ["k"]).collect()}
    assert got == {"A": ("PS", 92.0, 100.0, 109.0, 112.0), "B": ("P", 92.0, 100.0, 101.0, 104.0), "C": ("S", 92.0, 100.0, 100.0, 103.0)}
    wave = [1.0 if i < 1000 else 10.0 for i in range(1300)]  # a hundred a second from 90 s on
    traces = spark.createDataFrame([("A", 90.0, 100.0, wave), ("B", 90.0, 100.0, wave + [10.0] * 200), ("C", 95.0, 100.0, wave)], "k string, t0 double, fs double, samples array<double>")
    rows = {r["k"]: (r["case"], r["snr_db"]) for r in signal.cut_windows(traces, signal.phase_windows(picks, ["k"]), ["k"]).collect()}
    assert rows == {"B": ("P", pytest.approx(20.0))}  # A's signal and C's noise are cut off
    longer = traces.withColumn("samples", F.concat("samples", F.array_repeat(F.lit(10.0), 1000)))
    assert {r["k"] for r in signal.cut_windows(longer, signal.phase_windows(picks, ["k"]), ["k"]).collect()} == {"A", "B"}


def test_coherence_gates_pair_times(spark):
    pairs = spark.createDataFrame([(1, 2)], "id_a long, id_b long")
    picks = spark.createDataFrame([(i, s, "P", t) for i, s, t in ((1, "A", 5.0), (2, "A", 4.0), (1, "B", 3.0), (2, "B", 1.0), (1, "C", 1.0))], "id long, station string, phase string, travel_s double")
    assert match.pair_times(pairs, picks).count() == 2
    coherence = spark.createDataFrame([(1, 2, "A", "P", 0.1), (1, 2, "B", "P", 0.4)], "id_a long, id_b long, station string, phase string, coherence double")
    assert [(r["station"], r["dt"], r["coherence"]) for r in match.pair_times(pairs, picks, coherence).collect()] == [("B", 2.0, 0.4)]


def test_files_with_a_preamble(spark, tmp_path):
    for name, text in (("a", 'Global list, of\nvolcanoes\nName,lat,last\nHöd,1.5,\n"x, y",2,z\n,,\n'), ("b", "Name,lat,last\r\nName of it,3,w\r\n")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode("latin-1"))
    rows = sorted(map(tuple, readers.preamble_csv(spark, f"{tmp_path}/*.csv", ["name", "lat", "last"], "name").collect()), key=str)
    assert rows == sorted([("Höd", "1.5", None), ("x, y", "2", "z"), (None, None, None), ("Name of it", "3", "w")], key=str)


def test_scaled_nearest_needs_no_cross_join(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ev = lambda rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, time_s double, lat double, lon double")
    far = match.nearest_scaled(ev([(0, 0, 0), (1e9, 89, 0)]), ev([(5e8, -10, 170), (5.1e8, 80, 3)]), rounds=2)
    assert {r["id"]: r["ref_id"] for r in far.collect()} == {0: 0, 1: 1}
    assert match.nearest_scaled(ev([(0, 0, 0)]), ev([]), rounds=2).count() == 0
