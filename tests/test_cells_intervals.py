"""Dyadic interval joins, cells on the sphere and what stands on them, against nested loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import cells, intervals, match, selection


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def epochs_of(rng, n):
    """A station with most of the epochs, from seconds to years, some endless, empty, reversed or without a start."""
    out = []
    for i in range(n):
        start = dt.datetime(2010, 1, 1) + dt.timedelta(seconds=rng.randrange(0, 10**8))
        length = dt.timedelta(seconds=2 ** rng.randrange(0, 28) + rng.randrange(3), microseconds=rng.randrange(10**6))
        end = None if i % 11 == 0 else start if i % 13 == 0 else start - length if i % 17 == 0 else start + length
        out.append(("hot" if i % 3 else rng.choice("AB"), None if i % 29 == 0 else start, end, i))
    return out


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(5)
    e = epochs_of(rng, 300)
    times = [("hot" if i % 2 else rng.choice("ABC"), rng.choice([x[1] for x in e if x[1]]) + dt.timedelta(seconds=rng.choice([-1, 0, 0, 1, 5, 10**5, 10**7]))) for i in range(400)]
    times += times[:20] + [(None, times[0][1]), ("hot", None), ("hot", dt.datetime(1969, 5, 5)), ("hot", e[1][2] or e[2][2])]
    rows = [(i, s, t) for i, (s, t) in enumerate(times)]
    best = lambda s, t: min((x for x in e if s == x[0] and t and x[1] and x[1] <= t and (x[2] is None or t < x[2])), key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[3]), default=(None,) * 4)
    epochs = spark.createDataFrame(e, "sta string, start_date timestamp, end_date timestamp, e int")
    got = match.interval_join(spark.createDataFrame(rows, "i int, sta string, t timestamp").repartition(3), epochs, "sta", "t").collect()
    assert {r["i"]: (r["epoch_start_date"], r["epoch_e"]) for r in got} == {i: (best(s, t)[1], best(s, t)[3]) for i, s, t in rows} and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["timestamp", "date", "double"])
def test_availability(spark, kind):
    rng = random.Random(6)
    value = lambda d: (dt.datetime(2011, 1, 1) + dt.timedelta(days=d)) if kind != "double" else d * 86400.0
    inv = [(rng.choice("AB"), rng.choice(["HHZ", "BH1", "EHE", "HNX", None]), d := rng.randrange(90), rng.choice([None, d + rng.randrange(1, 40)])) for _ in range(60)]
    picks = [(i, rng.choice("ABC"), rng.randrange(120)) for i in range(200)] + [(900, None, 3), (901, "A", None)]
    cast = lambda df, *c: df.withColumns({x: F.col(x).cast("date") for x in c}) if kind == "date" else df
    sql = "double" if kind == "double" else "timestamp"
    inventory = cast(spark.createDataFrame([(s, c, value(a), None if b is None else value(b)) for s, c, a, b in inv], f"station string, channel string, start_date {sql}, end_date {sql}"), "start_date", "end_date")
    df = cast(spark.createDataFrame([(i, s, None if t is None else value(t)) for i, s, t in picks], f"i int, station string, time {sql}"), "time")
    got = {r["i"]: tuple(r[n] for n in intervals.FLAGS) for r in match.availability_at(df, inventory).collect()}
    tests = [lambda c: c.endswith("Z"), lambda c: c[-1] in "EN12", *(lambda c, b=b: c.startswith(b) for b in ("HH", "BH", "EH"))]
    for i, s, t in picks:
        own = [c for x, c, a, b in inv if x == s and t is not None and c and a <= t and (b is None or t < b)]
        assert got[i] == tuple(any(f(c) for c in own) for f in tests), i
    assert match.availability_at(df, inventory.limit(0)).where("has_vertical").count() == 0


def sphere(rng, n):
    """Points everywhere, about the date line, the poles and a swarm."""
    out = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    out += [(rng.uniform(-5, 5), rng.choice([-180.0, 180.0, 179.999, -179.99, 180.01, -190.0])) for _ in range(n // 4)]
    out += [(rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(n // 4)] + [(90.0, 7.0), (-90.0, 0.0), (0.0, 0.0), (0.0, 360.0)]
    return out + [(45 + rng.uniform(-0.01, 0.01), -125 + rng.uniform(-0.01, 0.01)) for _ in range(n // 2)]


def test_regions_equal_nested_loops(spark):
    rng = random.Random(7)
    points = list(enumerate(sphere(rng, 80)))
    nodes = [(rng.choice("PQRS"), a, o, rng.choice([0.0, 1.0, 30.0, 400.0, 3000.0, 11000.0]), rng.choice([0.0, 5.0])) for a, o in sphere(rng, 20)] + [("Z", None, 1.0, 1.0, 1.0), ("Z", 1.0, 1.0, None, 1.0)]
    p = spark.createDataFrame([(i, a, o) for i, (a, o) in points] + [(999, None, 1.0)], "id int, lat double, lon double")
    n = spark.createDataFrame(nodes, "region string, lat double, lon double, radius double, buffer_zone double")
    want = {(i, r) for i, (a, o) in points for r, la, lo, rad, buf in nodes if la is not None and rad is not None and km(a, o, la, lo) <= rad + buf}
    rows = match.in_regions(p, n).select("id", "region").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert match.in_regions(p, n.limit(0)).count() == 0


def test_cells_hold_what_circles_cover(spark):
    rng = random.Random(8)
    rows = [(a, o, rng.choice([0.5, 20.0, 700.0, 9000.0]), rng.uniform(0, 360), rng.uniform(0, 0.9999)) for a, o in sphere(rng, 200) if abs(a) < 90]
    far = []
    for a, o, r, az, share in rows:  # a point inside each circle
        d = share * r / 6371.0
        la = math.asin(math.sin(math.radians(a)) * math.cos(d) + math.cos(math.radians(a)) * math.sin(d) * math.cos(math.radians(az)))
        lo = math.radians(o) + math.atan2(math.sin(math.radians(az)) * math.sin(d) * math.cos(math.radians(a)), math.cos(d) - math.sin(math.radians(a)) * math.sin(la))
        far.append((a, o, r, math.degrees(la), math.degrees(lo)))
    df = spark.createDataFrame(far, "a double, o double, r double, la double, lo double").withColumn("level", cells.level_of(F.col("r")))
    y, x = cells.cell(F.col("level"), F.col("la"), F.col("lo"))
    own = df.select("*", cells.cover(F.col("level"), F.col("a"), F.col("o"), F.col("r")).alias("c"), F.struct(y.alias("y"), x.alias("x")).alias("p"))
    assert own.where(~F.array_contains("c", F.col("p"))).count() == 0
    assert own.where("abs(a) < 80 and r < 1000").agg(F.max(F.size("c"))).first()[0] <= 20


def test_pairs_and_isolation_equal_nested_loops(spark):
    rng = random.Random(9)
    for deg, reach, least in ((0.1, 25.0, 3), (20.0, 900.0, 12), (130.0, 6000.0, 40)):
        places = sphere(rng, 120)
        if deg == 0.1:
            places += [(round(a, 1), round(o, 1)) for a, o in places[:40]] + [(10 + k / 10, 20.0) for k in range(9)]
        df = spark.createDataFrame([(i, a, o) for i, (a, o) in enumerate(places)] + [(9999, None, None)], "id int, lat double, lon double")
        turn = lambda d: min(abs(d), abs(360 - abs(d)))
        wrapped = [(i, a, o) for i, (a, o) in enumerate(places) if -180 <= o <= 180]
        want = {(i, j) for i, a, o in wrapped for j, c, d in wrapped if i < j and abs(a - c) <= deg and turn(o - d) <= deg}
        inside = df.where("lon between -180 and 180")
        rows = match.event_pairs(inside, deg).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        near = {i for i, (a, o) in enumerate(places) if sum(km(a, o, c, d) <= reach for j, (c, d) in enumerate(places) if j != i) >= least}
        assert {r["id"] for r in match.drop_isolated(df, least, reach).collect()} == near


def test_selections(spark):
    t = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "id int, t double")
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert [ids(selection.time_window(t, "t", 1.0, 3.0, c)) for c in ("both", "left", "right", "neither")] == [[1, 2, 3], [1, 2], [2, 3], [2]]
    assert ids(selection.time_window(t, "t")) == [1, 2, 3] and ids(selection.time_window(t, "t", end=2.0)) == [1, 2]
    assert ids(selection.around(t, t.where("id = 2"), "t", 1.0)) == [1, 2, 3]
    assert ids(selection.inside_box_of(t, t.where("id < 3"), ["t"], {"t": 0.5})) == [1, 2] and selection.inside_box_of(t, t.limit(0), ["t"]).count() == 0
    assert ids(selection.without(t, t.where("id > 2"), ["t"])) == [1, 2, 4] and ids(selection.only(t, t.where("id > 2"), ["t"])) == [3]
    assert ids(selection.depth_band(t, 2.0, None, "t")) == [2, 3] and ids(selection.without_sentinels(t, "t", 1.0)) == [2, 3]
    m = spark.createDataFrame([(1, [("Md", 1.0), ("ML", None), ("MLv", 2.0)]), (2, [("mb", 1.0)]), (3, [])], "id int, m array<struct<mag_type: string, mag: double>>")
    assert [(r["id"], r["ml"]) for r in selection.first_magnitude(m, "m").collect()] == [(1, 2.0)]
    a, b = spark.createDataFrame([(1, "x", 5)], "k int, v string, w int"), spark.createDataFrame([(1, "y"), (1, "z"), (2, "q")], "k int, v string")
    assert selection.reconcile(a, b, ["k"]).columns == ["k", "v_df1", "w", "v_df2"] and selection.reconcile(a, b, ["k"]).count() == 2
    hits = selection.scaled_matches(spark.createDataFrame([(0.05,), (0.15,), (5.0,)], "metric double")).collect()
    assert [(r["n"], round(r["share"], 3)) for r in hits] == [(1, 0.333), (2, 0.667), (2, 0.667)]
    assert [r["share"] for r in selection.scaled_matches(spark.createDataFrame([], "metric double")).collect()] == [None] * 3
    o, p = spark.createDataFrame([("A", 10.0)], "sta string, origin_s double"), spark.createDataFrame([("A", 10.9), ("A", 11.0), ("A", 9.1), ("B", 10.0)], "sta string, otime double")
    assert sorted(r["otime"] for r in selection.same_station_origin(o, p).collect()) == [9.1, 10.9]
