"""Scans: declared schemas, column pruning after the scan, globs, odd layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

_D, _S, _L, _I, _T = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


PICKS_RAW = _schema(network=_S, station=_S, location=_S, band_inst=_S, label=_S, trace_starttime=_T, trigger_onset=_T, pick_time=_T, trigger_offset=_T, max_prob=_D, thresh_prob=_D)
ARRIVAL = _schema(arid=_L, sta=_S, iphase=_S, time=_D, prob=_D)
ASSOC = _schema(arid=_L, orid=_L, sta=_S, phase=_S, prob=_D, timeres=_D, slatitude=_D, slongitude=_D, selevation=_D, delta=_D, esaz=_D, seaz=_D)
ORIGIN = _schema(orid=_L, lat=_D, lon=_D, depth=_D, time=_D, nass=_I, p_picks=_I, s_picks=_I, rms=_D, nsphz=_I, gap=_D, algorithm=_S)
STATIONS = _schema(station=_S, latitude=_D, longitude=_D, elevation=_D)
STATION_EPOCHS = _schema(network=_S, station=_S, location=_S, channel=_S, latitude=_D, longitude=_D, elevation=_D, depth=_D, start_date=_T, end_date=_T, sample_rate=_D, has_response=T.BooleanType())
GRID = _schema(lon=_D, lat=_D, v=_D)
VELOCITY_1D = _schema(depth=_D, vp=_D, vp_grad=_D, vs=_D, vs_grad=_D)
REGION_NODES = _schema(latitude=_D, longitude=_D, radius=_D, buffer_zone=_D, velocity_model_id=_I)
WAVEFORM = _schema(network=_S, station=_S, channel=_S, t0=_T, fs=_D, samples=T.ArrayType(T.FloatType()))


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, columns: list[str] | None = None, sep: str = ",", header: bool = True, provenance: bool = False) -> DataFrame:
    """A CSV file, a glob or numbered parts as one table; index columns go. Without a schema all columns are text, which no value can break."""
    reader = spark.read.option("header", header).option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = C.drop_index_columns(C.strip_headers(df))
    if columns:
        df = df.select(*columns)
    return df.withColumn("source_file", F.input_file_name()) if provenance else df


def xyz(spark: SparkSession, path: str) -> DataFrame:
    """A headerless grid: lon (0 to 360 becomes -180 to 180), lat, v; rows without a value go."""
    df = csv(spark, path, GRID, header=False)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))).na.drop(subset=["v"])


def preamble_csv(spark: SparkSession, path: str, names: list[str], header_word: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A file with lines before its header, which is the first line that begins with ``header_word``: what follows it stays, empty last columns or not.

    Lines are told apart by their place in the file, so each file is read as a whole by one task; such files are short lists.
    """
    files = spark.read.format("binaryFile").load(path)
    lines = files.select(F.col("path").alias("_f"), F.posexplode(F.split(F.decode("content", encoding), "\r?\n")).alias("_at", "_line"))
    starts = F.lower(F.trim(F.regexp_replace("_line", '^[\\s"\ufeff]+', ""))).startswith(header_word.lower())
    head = lines.where(starts).groupBy(F.col("_f").alias("_h")).agg(F.min("_at").alias("_head"))
    rows = lines.join(head, (lines["_f"] == head["_h"]) & (F.col("_at") > F.col("_head"))).where(F.trim("_line") != "")
    parsed = F.from_csv("_line", ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE"})
    return rows.select(parsed.alias("r")).select("r.*")


def geojson_events(spark: SparkSession, path: str) -> DataFrame:
    """``lon, lat, depth, time`` of the features of GeoJSON files."""
    schema = "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<time: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return rows.select(F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(2)).alias("depth"), C.to_time(F.col("f.properties.time")).alias("time"))


def quakeml_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of QuakeML files: public id and first origin."""
    value = "struct<value: string>"
    schema = f"_publicID string, origin array<struct<time: {value}, latitude: {value}, longitude: {value}, depth: {value}>>"
    rows = spark.read.format("xml").option("rowTag", "event").schema(schema).load(path)
    o = F.get("origin", F.lit(0))
    return rows.select(F.col("_publicID").alias("id"), C.to_time(o["time"]["value"]).alias("time"), *[C.number(o[c]["value"]).alias(c) for c in ("latitude", "longitude", "depth")])


def missing_parts(df: DataFrame, pattern: str = r"part_?(\d+)") -> list[int]:
    """Numbers absent between 0 or 1 and the last part read; ``df`` was read with ``provenance``."""
    seen = {r[0] for r in df.select(F.regexp_extract("source_file", pattern, 1).try_cast("int")).distinct().collect()} - {None}
    return sorted(set(range(min(seen, default=0), max(seen, default=-1) + 1)) - seen)


def waveforms(spark: SparkSession, path: str, network: str, station: str, day: str, days: int = 1) -> DataFrame:
    """Traces of a table partitioned by network and day: both are pruned before any sample is read."""
    first = F.to_date(F.lit(day))
    return spark.read.parquet(path).where((F.col("network") == network) & F.col("day").between(first, F.date_add(first, days - 1)) & (F.col("station") == station))


def routed(main: DataFrame, other: DataFrame, networks: tuple[str, ...] = ("NC", "BK")) -> DataFrame:
    """Two archives as one table: some networks come from the second."""
    return main.where(~F.col("network").isin(*networks)).unionByName(other.where(F.col("network").isin(*networks)), allowMissingColumns=True)
