"""Arrivals summed by station and phase, dealt out by event."""

from pyspark.sql import functions as F

from quakeloom.operators import relational


def test_tasks_grow_with_arrivals_and_sums_are_whole(spark, monkeypatch):
    """Small tasks make many: a left join that gives every arrival's row, with unknown and null events and missing depths."""
    monkeypatch.setattr(relational, "PER_TASK", 50)
    arrivals = spark.range(1000).select((F.col("id") % 7).alias("sta"), F.when(F.col("id") % 2 == 0, "P").otherwise("S").alias("iphase"), F.when(F.col("id") % 11 != 0, F.col("id") % 90).alias("orid"), (F.col("id") * 0.5).alias("amp"))
    origins = spark.range(80).select(F.col("id").alias("orid"), F.when(F.col("id") % 3 != 0, F.col("id") / 10.0).alias("depth"), F.lit(1).alias("rms"))
    want = arrivals.join(origins, "orid", "left").groupBy("sta", "iphase").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("orid").alias("events"), F.round(F.avg("depth"), 9).alias("mean_depth"), F.sum("amp").alias("amp"))
    got = relational.arrival_summary(arrivals, origins)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and ", 20" in plan  # 1000 arrivals, 50 a task
    assert sorted(map(tuple, got.withColumn("mean_depth", F.round("mean_depth", 9)).collect())) == sorted(map(tuple, want.collect()))
    none = relational.arrival_summary(arrivals.where("orid = 0"), origins).first()
    assert none["mean_depth"] is None and none["events"] == 1
