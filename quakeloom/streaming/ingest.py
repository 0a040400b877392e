"""Incremental ingest with Structured Streaming: picks from a folder, duplicates, rates and greedy de-duplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import greedy_walk
from ..sources.readers import PICKS_RAW


def read_picks(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New station-day files of a folder, each read once."""
    reader = spark.readStream.schema(PICKS_RAW).option("header", True)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).csv(folder)


def append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a Parquet table exactly once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def without_repeats(picks: DataFrame, delay: str = "1 day", keys: tuple[str, ...] = ("network", "station", "label", "pick_time")) -> DataFrame:
    """The first pick of each key within the watermark."""
    return picks.withWatermark("pick_time", delay).dropDuplicatesWithinWatermark(list(keys))


def event_rate(events: DataFrame, ts: str = "ts", width: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Counts of tumbling windows, given out once a window is past the watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n")


def monthly_table(path: str, ts: str = "ts"):
    """A function for ``foreachBatch`` that keeps a table of counts by calendar month, one row set for each batch; replays overwrite theirs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.date_trunc("month", ts).alias("month")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def dedupe_stream(events: DataFrame, dt_s: float = 10, dist_km: float = 25, delay: str = "1 minute", by: str | None = None) -> DataFrame:
    """Kept event ids. Events that can conflict are within one session window, which is walked when it closes; rows later than the watermark are dropped.

    ``events``: id, ts, lat, lon. ``by``: a column, such as a region far from the others, whose values never conflict.
    """
    key = F.col(by) if by else F.pmod("id", F.lit(1))  # session windows need a key: one for all
    gap = f"{int(dt_s)} seconds 1 microsecond"
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key.alias("k")).agg(F.collect_list(F.struct("id", (F.unix_micros("ts") / 1e6).alias("time_s"), "lat", "lon")).alias("rows"))

    @F.pandas_udf("array<long>")
    def kept(sessions: pd.Series) -> pd.Series:
        out = []
        for s in sessions:
            df = pd.DataFrame(list(s), columns=["id", "time_s", "lat", "lon"]).sort_values(["time_s", "lat", "lon", "id"], ignore_index=True)
            out.append(df.loc[greedy_walk(df, dt_s, dist_km), "id"].tolist())
        return pd.Series(out)

    return rows.select(F.explode(kept("rows")).alias("id"))
