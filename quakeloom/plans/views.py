"""Catalogue-shaped views of the driver's tables: the same arithmetic in Spark and, as ``WITH`` parts, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import to_epoch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, a: int, b: int, lat: str | None = None) -> list:
    return [(40 + (F.col(lat or key) * a % 1000) / 100.0).alias("lat"), (-130 + (F.col(key) * b % 900) / 100.0).alias("lon")]


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), to_epoch(F.col("ts")).alias("time_s"), *_place("event_id", 37, 7919, "user_id"), ((F.col("event_id") * 31 % 600) / 10.0).alias("depth"), (F.log(1 + F.col("value")) / 2).alias("mag"), F.col("event_type").alias("cat"), F.col("ts").cast("timestamp").alias("ts"), "user_id")


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins(spark, sf_dir).where("cat not in ('view', 'click')").drop("ts", "cat", "user_id")


def catalogue(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return origins(spark, sf_dir).where(F.col("cat") == kind).drop("ts", "cat", "user_id")


def assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    phase = F.when(F.col("l_linenumber") % 2 == 1, "P").otherwise("S")
    return i.select(F.col("l_orderkey").alias("orid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arid"), F.col("l_suppkey").alias("sta"), phase.alias("phase"), (F.col("l_discount") - F.col("l_tax")).alias("timeres"), F.col("l_extendedprice").alias("amp"), (1 + F.col("l_quantity") * 4).alias("dist"), F.col("l_shipdate").alias("pick_time"), "l_partkey", "l_linenumber")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("sta"), *_place("s_suppkey", 137, 61), F.col("s_nationkey").alias("net"), (F.col("s_suppkey") * 13 % 2000).cast("double").alias("elevation"))


def order_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("orid"), *_place("o_orderkey", 37, 7919), ((F.col("o_orderkey") * 31 % 600) / 10.0).alias("depth"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderkey") % 50 / 10.0).alias("rms"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") * 100).cast("double").alias("t0"), F.lit(1.0).alias("fs"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), "label")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells x, y on a 40 by 40 lattice with the mean part size of the keys that fall there."""
    p = table(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 40).alias("x"), (F.floor(F.col("p_partkey") / 40) % 40).alias("y")).agg(F.avg("p_retailprice").alias("z"))


ORIGIN = "origin_v as (select event_id as id, epoch(ts) as time_s, 40 + (user_id * 37 % 1000) / 100.0::double as lat, -130 + (event_id * 7919 % 900) / 100.0::double as lon, (event_id * 31 % 600) / 10.0::double as depth, ln(1 + value) / 2 as mag, event_type as cat, ts, user_id from events), local_v as (select * from origin_v where cat not in ('view', 'click'))"
ASSOC = "assoc_v as (select l_orderkey as orid, l_orderkey * 10 + l_linenumber as arid, l_suppkey as sta, if(l_linenumber % 2 = 1, 'P', 'S') as phase, l_discount - l_tax as timeres, l_extendedprice as amp, 1 + l_quantity * 4 as dist, l_shipdate as pick_time, l_partkey, l_linenumber from lineitem)"
STATION = "station_v as (select s_suppkey as sta, 40 + (s_suppkey * 137 % 1000) / 100.0::double as lat, -130 + (s_suppkey * 61 % 900) / 100.0::double as lon, s_nationkey as net, (s_suppkey * 13 % 2000)::double as elevation from supplier)"
ORDER = "order_v as (select o_orderkey as orid, 40 + (o_orderkey * 37 % 1000) / 100.0::double as lat, -130 + (o_orderkey * 7919 % 900) / 100.0::double as lon, (o_orderkey * 31 % 600) / 10.0::double as depth, o_orderdate as ts, (o_orderkey % 50) / 10.0::double as rms from orders)"
TRACE = "trace_v as (select vec_id as id, (vec_id * 100)::double as t0, 1.0::double as fs, embedding::double[] as samples, label from embeddings)"
RASTER = "raster_v as (select p_partkey % 40 as x, (p_partkey // 40) % 40 as y, avg(p_retailprice) as z from part group by 1, 2)"


def hav(a: str, b: str, c: str, d: str) -> str:
    """SQL of the great-circle distance."""
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def azimuth(a: str, b: str, c: str, d: str) -> str:
    raw = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(({raw} + 360) - 360 * floor(({raw} + 360) / 360))"
