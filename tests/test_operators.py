"""Operators on small tables with results worked out by hand, and properties on random ones."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quakeloom.functions import columns as C
from quakeloom.functions import geo, signal
from quakeloom.operators import associate, classify, magnitude, match, relational, stats


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))


def one(df):
    return df.first()[0]


def test_geometry(spark):
    d = spark.range(1)
    assert one(d.select(geo.haversine_km(0.0, 0.0, 0.0, 180.0))) == pytest.approx(math.pi * 6371)
    assert one(d.select(geo.bearing(0.0, 0.0, 0.0, 1.0))) == pytest.approx(90)
    assert one(d.select(geo.bearing(0.0, 179.5, 0.0, -179.5))) == pytest.approx(90)
    assert one(d.select(geo.wrap_longitude(F.lit(230.0)))) == -130
    assert one(d.select(geo.degrees_to_km(geo.km_to_degrees(25.0)))) == pytest.approx(25)
    assert one(d.select(geo.hypocentral_km(3.0, 3.0, 1000.0))) == 5
    assert tuple(one(d.select(geo.degree_minutes(F.lit(-45.5), "N", "S")))) == (45, 30.0, "S")
    assert one(d.select(geo.attenuation(0.0, 1.0, 0.0))) == pytest.approx(-5)


def test_columns(spark):
    rows = [(" STA.NET ", "0", "1.5", "20100102030405"), ("A.B", " s ", "x", "bad"), ("Q.R", "7", "NaN", None)]
    df = spark.createDataFrame(rows, " Sta : string, Ph : string, v: string, t: string".replace(" Sta ", "sta").replace(" Ph ", " ph "))
    got = df.select(C.flip_station(F.col("sta")).alias("a"), C.phase_code(F.col("ph")).alias("b"), C.number(F.col("v")).alias("c"), C.to_time(F.col("t"), "yyyyMMddHHmmss").alias("d")).collect()
    assert [r["a"] for r in got] == ["NET.STA", "B.A", "R.Q"] and [r["b"] for r in got] == ["P", "S", None]
    assert [r["c"] for r in got] == [1.5, None, None] and got[0]["d"] == dt.datetime(2010, 1, 2, 3, 4, 5) and got[1]["d"] is None
    odd = spark.createDataFrame([(1, 2)], ["Unnamed: 0", " Depth (km) "])
    assert C.drop_index_columns(C.strip_headers(odd)).columns == ["Depth (km)"]
    assert C.find_column(odd, ["lat", "depth"]) == " Depth (km) " and C.find_column(odd, ["x"]) is None
    with pytest.raises(ValueError, match="a, b"):
        C.require_columns(odd, ["a", "b"])
    for values, want in ((["1.5", "2"], dt.datetime(1970, 1, 1, 0, 0, 2)), (["2010-01-01T00:00:00", "1970-01-01T00:00:02"], dt.datetime(1970, 1, 1, 0, 0, 2))):
        assert C.time_of_either(spark.createDataFrame([(v,) for v in values], "t string"), "t").collect()[1][0] == want
    a, b = (spark.createDataFrame([(i, x) for i in range(40)], f"i int, {x} string") for x in ("p", "q"))
    assert C.graft_by_position(a, b, ["i"], ["i"], ["q"]).where("q = 'q'").count() == 40
    with pytest.raises(ValueError):
        C.graft_by_position(a, b.limit(3), ["i"], ["i"], ["q"])
    shuffled = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int")
    assert all(r["v"] == r["pick_id"] for r in C.row_ids(shuffled, ["v"]).collect())
    assert one(spark.range(1).select(C.event_code(F.lit("1.25")))) == "ev1_25" and one(spark.range(1).select(C.coded_id("uwq", F.lit(7)))) == "uwq00007"


def events(spark, rows):
    return spark.createDataFrame([(i, float(t), float(a), float(o), float(m)) for i, (t, a, o, m) in enumerate(rows)], "id long, time_s double, lat double, lon double, mag double")


def test_match_bounds(spark):
    ref = events(spark, [(0, 0, 0, 0)])
    local = events(spark, [(10, 0, 0, 1), (-10, 0, 0, 2), (10.0001, 0, 0, 5)])
    ids = lambda **k: [r["id"] for r in match.match_events(ref, local, 10, 25, **k).collect()]
    assert ids() == [0] and ids(half_open=True) == [1] and ids(strict=True) == [] and ids(rank_by="mag") == [1]
    far = events(spark, [(0, 0, 0.3, 0)])
    assert match.match_events(ref, far, 10, 25).count() == 0 and match.match_events(ref, far, 10, 40).count() == 1
    wrap = match.match_events(events(spark, [(0, 0, 180, 0)]), events(spark, [(86_400 * 0 + 1, 0, -180, 0)]), 10, 25)
    assert wrap.count() == 1
    two = events(spark, [(0, 0, 0, 0), (1, 0, 0, 0)])
    assert match.match_events(two, local.where("id = 0"), 20, 25).count() == 2
    assert match.match_events(two, local.where("id = 0"), 20, 25, one_to_one=True).count() == 1
    assert match.match_events(ref, local.withColumn("lat", F.lit(None).cast("double")), 10, 25).count() == 0


def test_nearest_scaled_equals_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.uniform(0, 5e4), rng.uniform(40, 50), rng.uniform(-130, -121), 0) for _ in range(n)]
    a, b = make(60), make(40)
    got = {r["id"]: r["ref_id"] for r in match.nearest_scaled(events(spark, a), events(spark, b), rounds=3).collect()}

    def metric(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return math.hypot((p[0] - q[0]) / 120, 2 * 6371 * math.asin(math.sqrt(h)) / 25)

    assert got == {i: min(range(len(b)), key=lambda j: metric(p, b[j])) for i, p in enumerate(a)}


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 99.0)], "id int, t double")
    right = spark.createDataFrame([(7, 9.0), (8, 11.0), (9, 22.5)], "id int, t double")
    assert {r["id"]: r["right_id"] for r in match.asof_nearest(left, right, "t").collect()} == {1: 7, 2: None, 3: None}
    day = lambda n: dt.datetime(2011, 1, n)
    epochs = spark.createDataFrame([("A", day(1), day(5), 1), ("A", day(4), None, 2)], "sta string, start_date timestamp, end_date timestamp, e int")
    rows = spark.createDataFrame([("A", day(4)), ("A", day(5)), ("A", dt.datetime(2010, 1, 1)), ("B", day(4))], "sta string, t timestamp")
    assert [r["epoch_e"] for r in match.interval_join(rows, epochs, "sta", "t").orderBy("sta", "t").collect()] == [None, 1, 2, None]


def test_dedupe_equals_the_walk(spark):
    chain = events(spark, [(0, 0, 0, 0), (8, 0, 0, 0), (16, 0, 0, 0), (16, 5, 0, 0), (26, 5, 0, 0)])
    assert sorted(r["id"] for r in relational.dedupe_events(chain).collect()) == [0, 2, 3]
    rng = random.Random(4)
    rows = [(rng.uniform(0, 40_000), rng.uniform(0, 0.6), rng.uniform(0, 0.6), 0) for _ in range(1500)]
    df = pd.DataFrame(rows, columns=["time_s", "lat", "lon", "mag"]).assign(id=range(1500)).sort_values(["time_s", "lat", "lon", "id"], ignore_index=True)
    want = set(df.loc[relational.greedy_walk(df, 30, 25), "id"])
    for most in (20_000, 3):  # the second settles larger sessions in rounds
        got = {r["id"] for r in relational.dedupe_events(events(spark, rows), 30, 25, max_session=most).collect()}
        assert got == want


def test_gap_and_gate(spark):
    az = lambda *v: one(spark.createDataFrame([(float(x),) for x in v], "a double").agg(relational.azimuthal_gap(F.col("a"))))
    assert az(350, 10) == 340 and az(0, 90, 180, 270) == 90 and az(30) == 0
    assert one(spark.createDataFrame([(30.0,)], "a double").agg(relational.azimuthal_gap(F.col("a"), "full"))) == 360
    rows = spark.createDataFrame([(1, 4, 4, 2.5), (2, 4, 4, 2.4999), (3, 3, 9, 1.0), (4, None, 4, 1.0)], "orid int, p_picks int, s_picks int, rms double")
    assert [r[0] for r in relational.qc_gate(rows).collect()] == [2]
    assert [r["qc_pass"] for r in relational.qc_gate(rows, flag_only=True).orderBy("orid").collect()] == [False, True, False, False]
    near = spark.createDataFrame([(1, 10.0), (1, 40.0), (1, 141.0), (2, 10.0), (2, 40.0), (2, 140.0), (3, 5.0)], "id int, dist double")
    assert [r[0] for r in relational.station_geometry_ok(near).collect()] == [2]


def test_catalogue_tables(spark):
    cat = spark.createDataFrame([(44.0, -125.0, 10.0, " 2011-01-01T00:00:00.5", 1, 1, 1, 0.5, 9.0)], ["Latitude", "Longitude", " Depth (km)", " Origin Time (UTC)", " Event ID ", " Num. P", " Num. S", " RMS Residual (s)", " Detection Value"])
    picks = spark.createDataFrame([("2011-01-01T00:00:09", " ST.NE ", 0, 0.1, 1, 5), ("2011-01-01T00:00:12", "ST.NE", 1, 0.2, 2, 6)], ["Pick Time (UTC)", " Station Name", " Phase Type", " Residual (s)", " Event ID", " Pick ID "])
    e, p = relational.normalize_reloc(cat, picks)
    stations = spark.createDataFrame([("NE.ST", 44.5, -125.0, 20.0)], "station string, latitude double, longitude double, elevation double")
    a = relational.assignments(p.withColumn("prob", F.lit(0.9)), e, stations)
    assert a.count() == 2 and relational.build_origin(a).where("lat is not null").count() == 1
    assoc, origin = relational.event_geometry(relational.build_assoc(a), relational.build_origin(a).where("lat is not null"))
    assert assoc.where("orid = 1").first()["delta"] == pytest.approx(0.49965, abs=1e-5) and origin.first()["gap"] == 0  # on the ellipsoid
    assert relational.denormalize(relational.build_arrival(a), assoc, origin).count() == 2
    two = relational.union_catalogs([spark.createDataFrame([("a", 1)], "id string, x int"), spark.createDataFrame([("a", 2, 5), ("b", 3, 6)], "id string, x int, y int")], ["id"], ["x"])
    assert sorted(map(tuple, two.collect()), key=str) == [("a", 1, None), ("b", 3, 6)]
    assert relational.mark_repeats(two.unionAll(two), ["id"], ["x"]).where("is_repeat").count() == 2
    n = spark.range(50).withColumnRenamed("id", "k")
    assert relational.sample_rows(n, 7, "k", 1).collect() == relational.sample_rows(n, 7, "k", 1).collect() and relational.sample_with_replacement(n, 80, "k").count() == 80
    assert [r[0] for r in relational.slice_rows(n, ["k"], 10, 3).collect()] == [10, 11, 12]


def test_core_is_a_fixed_point(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.randrange(25)) for _ in range(320)]
    left = rows
    while True:
        stations = [s for _, s in left]
        left2 = [r for r in left if stations.count(r[1]) >= 8]
        es = [e for e, _ in left2]
        left2 = [r for r in left2 if es.count(r[0]) >= 3]
        if len(left2) == len(left):
            break
        left = left2
    df = spark.createDataFrame(rows, "event_id int, station int")
    assert sorted(map(tuple, magnitude.kcore_prune(df).collect())) == sorted(left)


def planted(spark, noise=0.0):
    rng = np.random.default_rng(3)
    m = rng.uniform(-1, 3, 120)
    c = {(s, p): v for p in "PS" for s, v in enumerate(rng.normal(0, 0.3, 15) - 0)}
    for p in "PS":
        mean = np.mean([c[s, p] for s in range(15)])
        c |= {(s, p): c[s, p] - mean for s in range(15)}
    k = {"P": 3.5e-4, "S": 1.1e-3}
    rows = []
    for e in range(120):
        for s in range(15):
            for p in "PS":
                r = float(rng.uniform(10, 300))
                rows.append((e, f"S{s}", p, r, float(m[e] + c[s, p] - math.log10(r / 100) - k[p] * r + noise * rng.normal())))
    return m, c, k, spark.createDataFrame(rows, "event_id int, station string, phase string, dist_hypo_km double, log10A double")


def test_inversion_recovers_what_was_planted(spark):
    m, c, k, obs = planted(spark)
    mags, terms, coeffs = magnitude.invert_magnitudes(obs, damp=1e-6, fix_n=1.0)
    got = np.array([r[1] for r in mags.orderBy("event_id").collect()])
    assert np.abs(got - m).max() < 1e-3 and coeffs["k|P"] == pytest.approx(k["P"], abs=1e-6) and coeffs["k|S"] == pytest.approx(k["S"], abs=1e-6)
    assert all(abs(r["C"] - c[int(r["station"][1:]), r["phase"]]) < 1e-3 for r in terms.collect())
    free = magnitude.invert_magnitudes(obs, damp=1e-6)[2]
    assert free["n|P"] == pytest.approx(1, abs=1e-3)
    res = magnitude.residuals(obs, mags, terms, coeffs)
    assert res.agg(F.max(F.abs("resid"))).first()[0] < 1e-3
    ev = magnitude.event_magnitudes(res)
    assert ev.where("n_P = 15 and n_S = 15").count() == 120
    out = magnitude.calibrate(ev, spark.createDataFrame([(2.0, 1.0)], "slope double, intercept double"), spread=0.2).first()
    assert out["ml"] == pytest.approx(2 * out["M_rel"] + 1) and out["ml_unc"] >= 0.2


def test_robust_rejection(spark):
    rows = spark.createDataFrame([(i, math.sin(i) * 0.1 * (100 if i % 100 == 7 else 1)) for i in range(1000)], "i int, resid double")
    kept = {r[0] for r in magnitude.reject_mad(rows).collect()}
    assert kept >= {i for i in range(1000) if i % 100 != 7} - {7} and len(kept) < 1000
    assert magnitude.reject_mad(rows.withColumn("resid", F.lit(0.0))).count() == 1000
    wa = spark.createDataFrame([("ok", None, "A", "1"), ("ok", 2.9, "A", ""), ("ok", 3.0, "A", ""), ("no_data", 9.0, "A", "")], "reason string, snr double, station string, epoch string")
    assert sorted(r[0] for r in magnitude.snr_gate(wa, epoch_station=True).select("station").collect()) == ["A", "A@1"]
    amp = spark.createDataFrame([("0",), ("-1",), (None,), ("x",), ("10",)], "amp string").selectExpr("amp", "0D evla", "0D evlo", "3D evdp", "0D stla", "0D stlo", "1000D stel_m")
    assert [r["log10A"] for r in magnitude.amplitude_distance(amp).collect()] == [1.0]


def test_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    r = stats.summary(df, "x").first()
    assert (r["p01"], r["median"], r["p99"]) == (1, 50, 99)
    h = {x["bin"]: x["n"] for x in stats.histogram(df, "x", 10).collect()}
    assert h[0] == 10 and h[9] == 11
    assert stats.density_2d(df.withColumn("y", F.col("x")), "x", "y", 10, 10, hexagons=True).agg(F.sum("n")).first()[0] == 101
    b = 1.0
    rng = np.random.default_rng(8)
    mags = spark.createDataFrame([(round(float(v), 1),) for v in 1.0 - 0.05 + rng.exponential(1 / (b * math.log(10)), 20_000)], "m double")
    mc = spark.createDataFrame([(1.0,)], "mc double")
    got = stats.b_value(mags, "m", mc).first()
    assert got["b"] == pytest.approx(1.0, abs=0.05) and 0 < got["sigma"] < 0.05
    assert stats.b_value(mags.limit(1), "m", mc).first()["b"] is None
    table = spark.createDataFrame([(1000, 5), (1100, 9), (1200, 9)], "mbin long, n long")
    assert stats.completeness(table, corr=0.2).first()[0] == pytest.approx(1.3)
    x = [float(i) for i in range(1, 12)]
    ts = stats.theil_sen(spark.createDataFrame([(v, 2 * v + 1 + (50 if v == 6 else 0)) for v in x], "x double, y double"), "x", "y").first()
    assert ts["slope"] == 2 and ts["low"] <= 2 <= ts["high"]
    a, bb = df, spark.createDataFrame([(float(i),) for i in range(50, 151)], "x double")
    d1, d2 = stats.ks_two_sample(a, bb, "x").first(), stats.ks_two_sample(bb, a, "x").first()
    assert d1["d"] == d2["d"] == pytest.approx(50 / 101) and d1["p"] < 1e-8 and stats.ks_two_sample(a, a, "x").first()["p"] == 1
    days = lambda y, m, n: dt.datetime(y, m, n)
    t = spark.createDataFrame([(days(2011, 1, 5),), (days(2011, 3, 1),)], "ts timestamp")
    assert [r["n"] for r in stats.monthly_rate(t, "ts").orderBy("month").collect()] == [1, 0, 1]
    ep = spark.createDataFrame([("A", days(2010, 12, 30), days(2011, 1, 4)), ("B", days(2011, 1, 2), None), ("C", days(2009, 1, 1), days(2009, 2, 1))], "station string, start_date timestamp, end_date timestamp")
    assert {r[0]: r[1] for r in stats.active_days(ep, "2011-01-01", "2011-01-11").collect()} == {"A": 3, "B": 9, "C": 0}


def test_classes_and_grids(spark):
    grid = spark.createDataFrame([(float(x), float(y), float(10 * x + y)) for x in range(4) for y in range(4) if (x, y) != (3, 3)], "lon double, lat double, v double")
    pts = spark.createDataFrame([(1, 0.5, 0.25), (2, 2.0, 2.0), (3, 2.5, 2.5), (4, 9.0, 0.0)], "id int, lat double, lon double")
    assert {r["id"]: r["v"] for r in classify.grid_bilinear(pts, grid, 1.0, "v").collect()} == {1: 3.0, 2: 22.0, 3: None, 4: None}
    assert {r["id"]: r["v"] for r in classify.raster_lookup(pts, grid, 1.0, "v").collect()} == {1: 0.0, 2: 22.0, 3: 22.0, 4: 3.0}
    cube = spark.createDataFrame([(float(d), float(a), float(o), float(d + 10 * a + 100 * o)) for d in (0, 1) for a in (0, 1) for o in (0, 1)], "depth double, lat double, lon double, v double")
    p3 = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 5.0, 0.0, 0.0)], "id int, depth double, lat double, lon double")
    assert {r["id"]: r["v"] for r in classify.model_trilinear(p3, cube, (1, 1, 1), "v").collect()} == {1: 55.5, 2: None}
    lattice = lambda v: spark.createDataFrame([(x / 2, y / 2, v) for x in range(5) for y in range(5)], "lon double, lat double, v double")
    ev = spark.createDataFrame([(1, 1.0, 1.0, 28.0), (2, 1.0, 1.0, 10.0), (3, 1.0, 1.0, 50.0), (4, 9.0, 9.0, 5.0), (5, 1.9, 1.9, 5.0)], "id int, lat double, lon double, depth double")
    vol = spark.createDataFrame([("V", 1.9, 1.9)], "name string, lat double, lon double")
    got = {r["id"]: r["event_class"] for r in classify.classify(ev, lattice(-20.0), lattice(3.0), vol, step=0.5).collect()}
    assert got == {1: "megathrust?", 2: "crustal-fault", 3: "intraslab", 4: "oceanic", 5: "volcanic"}


def test_signal(spark):
    ramp = spark.createDataFrame([(1, 0.0, 100.0, [float(i) for i in range(12_000)])], "id int, t0 double, fs double, samples array<double>")
    w = signal.windows(ramp, keep=["id"]).collect()
    assert [(r["win"], r["start"], r["samples"][0]) for r in w] == [(0, 0, 0.0), (1, 3000, 3000.0), (2, 6000, 6000.0)]
    dead = spark.createDataFrame([([1.0] * 9,), ([1.0, 2.0],)], "s array<double>")
    assert [r[0] for r in dead.select(signal.is_dead("s")).collect()] == [True, False]
    parts = spark.createDataFrame([("A", "Z", [1.0, 2.0]), ("A", "1", [3.0, 4.0]), ("B", "N", [5.0, 6.0])], "sta string, component string, samples array<double>")
    got = {r["sta"]: r for r in signal.assemble(parts, ["sta"]).collect()}
    assert got["A"]["e"] == [3.0, 4.0] and got["A"]["n"] == [0.0, 0.0] and got["B"]["z"] == [0.0, 0.0]
    assert {r["sta"]: r["n"] for r in signal.assemble(parts, ["sta"], replicate_vertical=True).collect()}["A"] == [1.0, 2.0]
    series = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate([0.9, 0, 0.05, 0.2, 0.2, 0, 0.5])], "k int, sample int, p double")
    assert [(r["onset"], r["offset"], r["pick"]) for r in signal.trigger(series, ["k"], 0.05, 1).orderBy("onset").collect()] == [(2, 4, 3), (6, 6, 6)]
    t = np.arange(2000) / 100
    mix = spark.createDataFrame([(0.0, 100.0, (np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 0.2 * t)).tolist())], "t0 double, fs double, samples array<double>")
    x = np.array(signal.bandpass(mix, 2, 10).first()["samples"])[500:1500]
    assert np.abs(x - np.sin(2 * np.pi * 5 * t)[500:1500]).max() < 0.05
    y = np.array(signal.resample(mix, 50).first()["samples"])
    assert len(y) == 1000 and np.abs(y[100:900] - (np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 0.2 * t))[::2][100:900]).max() < 0.1
    seg = spark.createDataFrame([("A", 0.0, 1.0, [0.0, 1.0]), ("A", 4.0, 1.0, [4.0, 5.0])], "sta string, t0 double, fs double, samples array<double>")
    assert signal.fill_gaps(seg, ["sta"]).first()["samples"] == [0, 1, 2, 3, 4, 5]
    noise = np.random.default_rng(1).normal(size=400)
    pair = spark.createDataFrame([(noise[5:305].tolist(), noise[:300].tolist(), 100.0)], "a array<double>, b array<double>, fs double")
    d = signal.pair_delay(pair).first()
    assert abs(d["delay"]) == pytest.approx(0.05, abs=0.02) and d["coherence"] > 0.5
    mid = spark.createDataFrame([(dt.datetime(2011, 1, 1, 23, 59), dt.datetime(2011, 1, 2, 0, 1)), (dt.datetime(2011, 1, 1, 1), dt.datetime(2011, 1, 1, 2))], "a timestamp, b timestamp")
    assert [len(r[0]) for r in mid.select(signal.split_midnight(F.col("a"), F.col("b"))).collect()] == [2, 1]
    assert one(spark.range(1).select(signal.snr_db(F.lit([10.0, -10.0]), F.lit([1.0, 1.0])))) == pytest.approx(20)
    inv = spark.createDataFrame([("A", "BHZ"), ("A", "HHZ"), ("B", "EHZ")], "sta string, channel string")
    assert {r[0]: r[1] for r in signal.preferred_channels(inv, ["sta"]).collect()} == {"A": "HH", "B": "EH"}
    scored = signal.score_windows(signal.windows(mix.withColumn("id", F.lit(1)), 1000, 500, ["id"]), lambda: signal.sta_lta(), ["id"])
    assert scored.count() == 3 and signal.overlap_stack(scored, ["id"], (100, 100)).count() > 0
    wa = signal.simulate_wood_anderson(mix, *signal.WOOD_ANDERSON[:2], 1.0).first()["samples"]
    assert np.std(wa) == pytest.approx(2080 * np.std(mix.first()["samples"]), rel=0.1)


def test_association_finds_planted_events(spark):
    rng = random.Random(0)
    stations = [(f"S{i}", 44 + rng.uniform(-1, 1), -125 + rng.uniform(-1, 1), 0.0) for i in range(14)]
    nodes = [(i * 20 + j, 43.0 + i * 0.1, -126.0 + j * 0.1, 10.0, "r") for i in range(20) for j in range(20)]
    truth = [(1000.0, nodes[105]), (1500.0, nodes[250])]
    picks, n = [], 0
    for t, (_, a, o, d, _) in truth:
        for s, sa, so, _ in stations:
            h = math.sin(math.radians(sa - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(sa)) * math.sin(math.radians(so - o) / 2) ** 2
            km = math.hypot(2 * 6371 * math.asin(math.sqrt(h)), d)
            for phase, v in (("P", 6.0), ("S", 3.5)):
                picks.append((n, s, phase, t + km / v))
                n += 1
    picks += [(n + i, f"S{i % 14}", "P", 3000.0 + 97 * i) for i in range(20)]
    frames = (spark.createDataFrame(picks, "pick_id long, sta string, phase string, time_s double"), spark.createDataFrame(stations, "sta string, lat double, lon double, elevation double"), spark.createDataFrame(nodes, "node long, lat double, lon double, depth double, region string"), spark.createDataFrame([(0.0, 6.0, 3.5)], "depth double, vp double, vs double"))
    p, s, nd, v = frames
    e, a = associate.associate_picks(p, s, nd.drop("region"), v)
    found = sorted((r["time_s"], r["picks"]) for r in e.collect())
    for t, _ in truth:
        assert any(abs(f - t) < 1.0 and c >= 20 for f, c in found)
    assert a.where("pick_id >= 56").count() == 0
    regions = spark.createDataFrame([("r", 44.0, -125.0, 200.0, 50.0)], "region string, lat double, lon double, radius double, buffer_zone double")
    e2, a2 = associate.associate_by_region(p, s, regions, nd, v)
    assert e2.count() >= 2 and a2.count() > 40


def test_pairs(spark):
    rng = random.Random(5)
    rows = [(0, rng.uniform(44, 45), rng.uniform(-126, -125), 0) for _ in range(200)]
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if abs(rows[i][1] - rows[j][1]) <= 0.1 and abs(rows[i][2] - rows[j][2]) <= 0.1}
    assert {tuple(r) for r in match.event_pairs(events(spark, rows)).collect()} == want
    inv = spark.createDataFrame([("N", "S", "d", "HHZ"), ("N", "S", "d", "HHE")], "network string, station string, day string, channel string")
    r = match.availability(inv).first()
    assert r["has_vertical"] and r["has_horizontal"] and r["has_hh"] and not r["has_eh"]
    assert match.new_rows(spark.range(5), spark.range(3), ["id"]).count() == 2


def test_windows_and_norms_follow_the_formulas(spark):
    df = spark.createDataFrame([(10.0, "P"), (100.0, "P"), (600.0, "P"), (10.0, "S"), (1500.0, "S")], "r double, ph string")
    got = [tuple(x[0]) for x in df.select(signal.measure_window(F.col("r"), F.col("ph"))).collect()]
    tsp = lambda r: r * (1 / 3.5 - 1 / 6)
    want = [(0.3, max(min(1 + 0.03 * r, 15, 0.8 * max(tsp(r), 1.25)), 1)) if p == "P" else (0.3, min(2 + 0.06 * r, 60)) for r, p in df.collect()]
    assert np.allclose(got, want)
    z, e = np.sin(np.arange(40.0)), 2 * np.cos(np.arange(40.0)) + 1
    t = spark.createDataFrame([(z.tolist(), e.tolist())], "z array<double>, e array<double>")
    row = t.select(signal.normalized("z"), signal.normalized("z", "std", scale=signal.joint_deviation("z", "e"))).first()
    ramp = 0.5 * (1 + np.cos(np.linspace(np.pi, 2 * np.pi, 6)))
    edge = np.concatenate([ramp, np.ones(28), ramp[::-1]])
    both = np.stack([z - z.mean(), e - e.mean()])
    assert np.allclose(row[0], both[0] / np.abs(both[0]).max() * edge) and np.allclose(row[1], (both[0] / both.std() + 1e-10) * edge)


def test_nearest_k_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    place = lambda n: [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-80, 80, n), rng.uniform(-180, 180, n)))]
    p, s = place(60), place(40)
    points, named = spark.createDataFrame([*p, (99, None, 1.0)], "id long, lat double, lon double"), spark.createDataFrame([*s, (40, s[3][1], s[3][2])], "sta long, lat double, lon double")
    s = [*s, (40, s[3][1], s[3][2])]
    hav = lambda a, b, c, d: 2 * 6371.0 * np.arcsin(np.sqrt(min(1.0, np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2)))
    flat = lambda a, b, c, d, at: np.hypot((c - a) * 111.0, (d - b) * 111.0 * np.cos(np.radians(at)))
    for metric, f in (("sphere", lambda a, b, c, d: hav(a, b, c, d)), ("flat", lambda a, b, c, d: flat(a, b, c, d, a)), ("flat_named", lambda a, b, c, d: flat(a, b, c, d, c))):
        got = {(r["id"], r["rank"]): (r["sta"], r["km"]) for r in match.nearest_k(points, named, 3, "sta", metric=metric).collect()}
        assert len(got) == 180
        for i, a, o in p:
            want = sorted((f(a, o, c, d), j) for j, c, d in s)[:3]
            assert all(abs(got[(i, k + 1)][1] - want[k][0]) < 1e-6 for k in range(3))
    assert match.nearest_k(points, named.limit(0), 3, "sta").count() == 0 and match.nearest_k(points.limit(0), named, 3, "sta").count() == 0
