"""Sinks: plain, chunked, split by size, fixed-width location files, buckets, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import row_ids
from ..functions.geo import degree_minutes
from ..functions.lineage import cut
from ..functions.signal import pick_weight


def csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def chunked(df: DataFrame, path: str, rows: int, order: list[str] | None = None) -> None:
    """Files of at most ``rows`` rows; with an order, numbered parts by absolute row."""
    if order is None:
        df.write.option("maxRecordsPerFile", rows).parquet(path)
        return
    numbered = row_ids(df, order, "_row").withColumn("part", F.floor(F.col("_row") / rows))
    numbered.repartition("part").sortWithinPartitions("part", "_row").drop("_row").write.partitionBy("part").parquet(path)


def size_bounded(df: DataFrame, path: str, most_mb: float = 50.0, safety: float = 0.9) -> int:
    """CSV files of at most so many megabytes, by the mean length of a row; the number of rows to a file is returned."""
    mean = df.select(F.avg(F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])) + 1)).first()[0] or 1.0
    rows = max(1, int(most_mb * 1e6 * safety / mean))
    df.write.option("header", True).option("maxRecordsPerFile", rows).csv(path)
    return rows


def with_rejects(df: DataFrame, good: str, bad: str) -> None:
    """Rows whose reason is ok to one table, the others to another, both appended. What makes the rows runs once."""
    df = cut(df)
    df.where(F.col("reason") == "ok").write.mode("append").parquet(good)
    df.where(F.coalesce(F.col("reason"), F.lit("")) != "ok").write.mode("append").parquet(bad)


def bucketed(df: DataFrame, key: list[str], buckets: int = 11) -> DataFrame:
    """``bucket`` by hash of the key and ``trace_name``: the row's number in its bucket and its shape."""
    b = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy(*key)) - 1
    return b.withColumn("trace_name", F.concat(F.lit("bucket"), "bucket", F.lit("$"), n, F.lit(",:3,:"), F.array_size("samples")))


def station_lines(stations: DataFrame) -> DataFrame:
    """Fixed-width station lines: code, network, latitude and longitude in degrees and minutes, elevation."""
    la, lo = degree_minutes("latitude", "N", "S"), degree_minutes("longitude", "E", "W")
    rows = stations.withColumn("_a", la).withColumn("_o", lo)
    line = F.format_string("%-5s %-2s %2d %7.4f%s%3d %7.4f%s%4d", "sta", "net", "_a.degrees", "_a.minutes", "_a.hemisphere", "_o.degrees", "_o.minutes", "_o.hemisphere", F.col("elevation").cast("int"))
    return rows.select(line.alias("value"))


def arc_lines(events: DataFrame, picks: DataFrame, depth_scale: float = 100.0, terminator: str = "end", min_depth: float | None = None) -> DataFrame:
    """Event, pick and end lines of a location program's input: ``event_no, line, value``. Events without a P pick are left out."""
    e = events if min_depth is None else events.where(F.col("depth") >= min_depth)
    e = e.join(picks.where("phase = 'P'").select("event_no").distinct(), "event_no", "left_semi")
    e = e.withColumn("_a", degree_minutes("lat", "N", "S")).withColumn("_o", degree_minutes("lon", "E", "W"))
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmmssSS")
    head = F.format_string("%s%2d%s%4.0f%3d%s%4.0f%5d", stamp("time"), "_a.degrees", "_a.hemisphere", F.col("_a.minutes") * 100, "_o.degrees", "_o.hemisphere", F.col("_o.minutes") * 100, F.floor(F.col("depth") * depth_scale).cast("int"))
    body = F.format_string("%-5s%-2s %s%d %s", "sta", "net", "phase", pick_weight(F.col("prob")), stamp("pick_time"))
    p = picks.join(e.select("event_no"), "event_no", "left_semi").withColumn("line", F.row_number().over(Window.partitionBy("event_no").orderBy("pick_time", "sta", "phase")))
    heads = e.select("event_no", F.lit(0).alias("line"), head.alias("value"))
    ends = e.select("event_no", F.lit(1_000_000).alias("line"), F.lit(terminator).alias("value"))
    return heads.unionAll(p.select("event_no", "line", body.alias("value"))).unionAll(ends)


def write_arc(lines: DataFrame, path: str) -> None:
    """One text file set in event order; events never part."""
    lines.repartitionByRange("event_no").sortWithinPartitions("event_no", "line").select("value").write.text(path)


def formatted_tsv(df: DataFrame, path: str, digits: dict[str, int], times: list[str]) -> None:
    shown = df.withColumns({c: F.format_string(f"%.{n}f", c) for c, n in digits.items()} | {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in times})
    csv(shown, path, sep="\t")


def publish(tables: dict[str, DataFrame], root: str) -> None:
    """One folder for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
