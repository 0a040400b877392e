"""De-duplication by keyed state equals the batch walk for rows out of order, over several keys and batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import relational
from quakeloom.streaming import dedupe, ingest


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_the_walk(spark, tmp_path, seed):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/c")
    rng = random.Random(seed)
    t0 = dt.datetime(2011, 1, 1)
    rows = [(i, t0 + dt.timedelta(milliseconds=rng.randrange(900_000)), 44 + rng.uniform(0, 0.4), -125.0, rng.choice(["north", "south"])) for i in range(240)]
    rows += [(500 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(rows[:20])]  # ties
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, 50)))  # out of order by less than the delay
    df = spark.createDataFrame(rows, "id long, ts timestamp, lat double, lon double, region string")
    schema, step = df.schema, len(late) // 5
    parts = [late[i : i + step] for i in range(0, len(late), step)] + [[(9999, t0 + dt.timedelta(days=9), 0.0, 0.0, r)] for r in ("north", "south")] + [[(9998, t0 + dt.timedelta(days=10), 0.0, 0.0, "north")]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="providerClass"):
        dedupe.dedupe_state(df)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", dedupe.STORE)
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            ingest.append(dedupe.dedupe_state(stream, by="region"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect() if r[0] < 9990)
    want = []
    for region in ("north", "south"):
        own = df.where(F.col("region") == region).withColumn("time_s", F.unix_micros("ts") / 1e6)
        want += [r["id"] for r in relational.dedupe_events(own).collect()]
    assert got == sorted(want) and len(got) < 200
