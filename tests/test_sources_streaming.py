"""Readers, writers and streams over files made here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import relational
from quakeloom.sources import readers, writers
from quakeloom.streaming import ingest


def test_csv_variants(spark, tmp_path):
    (tmp_path / "picks_2011").mkdir()
    for i in (0, 2):
        (tmp_path / "picks_2011" / f"part_{i}.csv").write_text(f",  time , v\n0,{i},x\n")
    df = readers.csv(spark, f"{tmp_path}/picks_201[1-5]/*.csv", provenance=True)
    assert df.columns == ["time", "v", "source_file"] and df.count() == 2 and readers.missing_parts(df) == [1]
    (tmp_path / "g.xyz").write_text("230.0,44.0,-10\n231.0,44.0,NaN\n")
    assert [tuple(r) for r in readers.xyz(spark, f"{tmp_path}/g.xyz").collect()] == [(-130.0, 44.0, -10.0)]
    (tmp_path / "v.csv").write_bytes("Volcano list\nName,Lat,Lon\nH\xf6d,45.4,-121.7\n".encode("latin-1"))
    assert [r[0] for r in readers.preamble_csv(spark, f"{tmp_path}/v.csv", ["name", "lat", "lon"], "Name").collect()] == ["Höd"]
    (tmp_path / "t.json").write_text(json.dumps({"features": [{"geometry": {"coordinates": [-124.0, 47.0, 30.0]}, "properties": {"time": "2011-01-01T00:00:00"}}]}))
    assert tuple(readers.geojson_events(spark, f"{tmp_path}/t.json").first()) == (-124.0, 47.0, 30.0, dt.datetime(2011, 1, 1))
    (tmp_path / "q.xml").write_text('<q><event publicID="e1"><origin><time><value>2011-01-01T00:00:00</value></time><latitude><value>44.5</value></latitude><longitude><value>-125</value></longitude><depth><value>9000</value></depth></origin></event></q>')
    assert tuple(readers.quakeml_events(spark, f"{tmp_path}/q.xml").first())[2:] == (44.5, -125.0, 9000.0)


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    writers.chunked(df, f"{tmp_path}/c", 10, ["k"])
    back = spark.read.parquet(f"{tmp_path}/c")
    assert {(r["k"] // 10, r["part"]) for r in back.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert writers.size_bounded(df, f"{tmp_path}/s", 1e-5) >= 1 and spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 25
    writers.with_rejects(df.withColumn("reason", F.when(F.col("k") < 5, "no_data").otherwise("ok")), f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert (spark.read.parquet(f"{tmp_path}/ok").count(), spark.read.parquet(f"{tmp_path}/bad").count()) == (20, 5)
    b = writers.bucketed(df.withColumn("samples", F.array(F.lit(1.0))), ["k"])
    assert b.select("trace_name").distinct().count() == 25
    t = dt.datetime(2011, 1, 2, 3, 4, 5, 670000)
    ev = spark.createDataFrame([(1, t, 44.5, -125.25, 9.5), (2, t, 44.5, -125.25, 9.5)], "event_no int, time timestamp, lat double, lon double, depth double")
    pk = spark.createDataFrame([(1, "AAA", "XX", "P", 0.9, t), (2, "AAA", "XX", "S", 0.9, t)], "event_no int, sta string, net string, phase string, prob double, pick_time timestamp")
    lines = [r["value"] for r in writers.arc_lines(ev, pk).orderBy("event_no", "line").collect()]
    assert len(lines) == 3 and lines[0].startswith("2011010203040567") and lines[2] == "end"
    st = spark.createDataFrame([("AAA", "XX", 44.5, -125.25, 120.0)], "sta string, net string, latitude double, longitude double, elevation double")
    assert writers.station_lines(st).first()[0] == "AAA   XX 44 30.0000N125 15.0000W 120"
    writers.formatted_tsv(ev, f"{tmp_path}/tsv", {"lat": 3}, ["time"])
    assert "44.500" in {r["lat"] for r in readers.csv(spark, f"{tmp_path}/tsv", sep="\t").collect()}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "network,station,location,band_inst,label,trace_starttime,trigger_onset,pick_time,trigger_offset,max_prob,thresh_prob\n"
    line = "XX,AAA,,HH,P,2011-01-01T00:00:00,2011-01-01T00:00:01,2011-01-01T00:00:02,2011-01-01T00:00:03,0.9,0.05\n"
    (tmp_path / "in" / "a.csv").write_text(head + line)
    run = lambda: ingest.append(ingest.without_repeats(ingest.read_picks(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    (tmp_path / "in" / "b.csv").write_text(head + line)
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_dedupe_equals_batch(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    t0 = dt.datetime(2011, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rng.uniform(0, 3000)), 44 + rng.uniform(0, 0.4), -125.0) for i in range(150)] + [(999, t0 + dt.timedelta(days=3), 44.0, -125.0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, lat double, lon double")
    df.where("id < 999").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    df.where("id = 999").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ingest.append(ingest.dedupe_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()} - {999}
    batch = df.where("id < 999").withColumn("time_s", F.unix_micros("ts") / 1e6)
    assert got == {r["id"] for r in relational.dedupe_events(batch).collect()}
    rate = ingest.event_rate(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), width="1 hour")
    ingest.append(rate, f"{tmp_path}/rate", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/rate").agg(F.sum("n")).first()[0] == 150
