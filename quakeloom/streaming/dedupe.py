"""Greedy de-duplication as keyed state: events wait until the watermark has passed them, kept ones until nothing can conflict with them.

Needs the state store that supports it: ``spark.sql.streaming.stateStore.providerClass`` set to ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "id long, t long, lat double, lon double"


def near(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray, km: float) -> bool:
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon - lons) / 2) ** 2
    return bool((2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h))) <= km).any())


class GreedyWalk(StatefulProcessor):
    """State of a key: ``waiting`` events and ``kept`` ones, both as (id, microseconds, lat, lon)."""

    def __init__(self, dt_s: float, dist_km: float):
        self.dt, self.km = round(dt_s * 1_000_000), dist_km

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.kept = handle.getListState("waiting", _EVENT), handle.getListState("kept", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(r) for d in rows for r in d[["id", "t", "lat", "lon"]].itertuples(index=False)]
        if new:
            self.waiting.appendList([(int(i), int(t), float(a), float(o)) for i, t, a, o in new])
            # The watermark in whole milliseconds lies below an event until it has passed its millisecond.
            self.handle.registerTimer(max(t for _, t, _, _ in new) // 1000 + 1)
        yield pd.DataFrame({"id": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[1] < passed), key=lambda r: (r[1], r[2], r[3], r[0]))
        kept, out = list(self.kept.get()) if self.kept.exists() else [], []
        for i, t, lat, lon in ready:
            kept = [k for k in kept if t - k[1] <= self.dt]
            if not kept or not near(lat, lon, np.array([k[2] for k in kept]), np.array([k[3] for k in kept]), self.km):
                kept.append((i, t, lat, lon))
                out.append(i)
        later = [tuple(r) for r in rows if r[1] >= passed]
        kept = [tuple(k) for k in kept if passed - k[1] <= self.dt]
        for state, left in ((self.waiting, later), (self.kept, kept)):
            state.put(left) if left else state.clear()
        yield pd.DataFrame({"id": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


def dedupe_state(events: DataFrame, dt_s: float = 10, dist_km: float = 25, delay: str = "1 minute", by: str | None = None) -> DataFrame:
    """Kept event ids of a stream (id, ts, lat, lon), given out once the watermark has passed them; rows later than it are dropped.

    ``by``: a column whose values never conflict, such as a region far from the others; each is walked by itself. Without it there
    is one key. The result equals the batch walk whatever the order of rows within the watermark; an event without a time or place goes.
    A key holds the events of the watermark's delay and, of kept ones, the last ``dt_s``.
    """
    store = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if store != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    rows = events.where("ts is not null and lat is not null and lon is not null").withWatermark("ts", delay)
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = rows.select(key.alias("k"), "id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "lat", "lon")
    return rows.groupBy("k").transformWithStateInPandas(GreedyWalk(dt_s, dist_km), "id long", "append", "EventTime")
