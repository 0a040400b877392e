"""Exact quantiles, running sums and what stands on them against Spark's exact percentile and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import magnitude, order_stats, stats


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))


PROBS = [0.0, 0.01, 0.25, 0.5, 0.977, 1.0]


def values(seed):
    """A hot group, ties, one value only, wide ranges, nulls and small groups."""
    rng = random.Random(seed)
    hot = [("hot", rng.gauss(0, 1) if i % 3 else float(rng.randrange(4))) for i in range(6000)]
    wide = [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300)) for _ in range(900)]
    return hot + wide + [("same", 7.0)] * 500 + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), (None, 4.0), (None, 6.0)] + [("hot", None)] * 9


@pytest.mark.parametrize(("leaf", "accuracy"), [(10_000, 10_000), (40, 100), (3, 20)])
def test_quantiles_equal_the_exact_percentile(spark, monkeypatch, leaf, accuracy):
    """Small leaves and a coarse sketch make many splits, and brackets that miss."""
    monkeypatch.setattr(order_stats, "LEAF", leaf)
    monkeypatch.setattr(order_stats, "ACCURACY", accuracy)
    df = spark.createDataFrame(values(1), "g string, v double").repartition(5)
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect() if r["q"]}
    got = {r["g"]: r["q"] for r in order_stats.quantiles(df, "v", PROBS, ["g"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], rel=1e-12, abs=0) for g in want)
    whole = order_stats.quantiles(df.where("g <> 'wide'"), "v", [0.5]).first()["q"]
    assert whole == [np.percentile([v for g, v in values(1) if v is not None and g not in ("wide", None)], 50)]


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "LEAF", 10)
    found, real = [], order_stats._missed
    monkeypatch.setattr(order_stats, "_missed", lambda *a: found.append(real(*a).count()) or real(*a))
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.transform(p, lambda _: F.lit(-5.0)))
    df = spark.range(40).select(F.col("id").cast("double").alias("v"))
    with pytest.raises(RuntimeError):  # splits that part nothing are seen, too
        order_stats.quantiles(df, "v", [0.5])
    assert found == [1]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "g int, v double")
    assert order_stats.quantiles(df, "v", [0.5], ["g"]).count() == 0 and order_stats.quantiles(df, "v", [0.5]).count() == 0
    assert stats.summary(df, "v", ["g"]).first()["median"] is None and stats.mad(df, "v").first()["mad"] is None
    assert stats.summary(df.limit(0), "v").first()["n"] == 0 and magnitude.reject_mad(df, 4.0, "v").count() == 1  # without a deviation nothing goes


def test_describe_and_mad_equal_pandas(spark):
    rows = [(g, v) for g, v in values(2) if g != "wide" and v is not None and g is not None]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in stats.describe_by(df, "v", ["g"]).collect():
        own = [v for g, v in rows if g == r["g"]]
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(np.percentile(own, [25, 50, 75]).tolist()) and r["n"] == len(own)
    for r in stats.mad(df, "v", ["g"]).collect():
        own = np.array([v for g, v in rows if g == r["g"]])
        assert r["mad"] == pytest.approx(1.4826 * np.median(np.abs(own - np.median(own))))


def test_running_sums_and_ranks(spark):
    rng = random.Random(3)
    xs = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(float(x), x % 7) for x in xs], "x double, n long")
    got = {r["x"]: r["upto"] for r in order_stats.running_sums(df, "x", {"upto": "n"}).collect()}
    total = 0
    for x in sorted(xs):
        total += x % 7
        assert got[x] == total
    tied = spark.createDataFrame([(v,) for v in (5, 1, 1, 3, 5, 5)], "v int")
    assert sorted((r["v"], r["rank"]) for r in stats.average_rank(tied, "v", "rank").collect()) == [(1, 1.5), (1, 1.5), (3, 3.0), (5, 5.0), (5, 5.0), (5, 5.0)]
    assert order_stats.running_sums(df.limit(0), "x", {"s": "n"}).count() == 0
