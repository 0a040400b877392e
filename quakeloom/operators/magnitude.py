"""Amplitude-distance tables, pruning, the joint magnitude inversion and calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.geo import attenuation, haversine_km, hypocentral_km
from ..functions.lineage import cut
from .inversion import fit_magnitudes, invert_magnitudes  # noqa: F401  part of this module's interface
from .match import small
from .stats import mad
from .vectors import summed


def amplitude_distance(picks_amp: DataFrame) -> DataFrame:
    """Measurements with distances and log10 amplitude; without a positive, finite amplitude or a place they go."""
    amp = C.number(F.col("amp"))
    rows = picks_amp.withColumn("amp", amp).where("amp > 0 and amp < double('infinity') and evla is not null and evlo is not null and evdp is not null and stla is not null and stlo is not null and stel_m is not null")
    rows = rows.withColumn("dist_epi_km", haversine_km("evla", "evlo", "stla", "stlo"))
    return rows.withColumn("dist_hypo_km", hypocentral_km("dist_epi_km", "evdp", "stel_m")).withColumn("log10A", F.log10("amp"))


def snr_gate(wa_amp: DataFrame, min_snr: float = 3.0, epoch_station: bool = False) -> DataFrame:
    """Good measurements whose signal-to-noise ratio is high enough or missing; stations may be keyed by epoch."""
    rows = wa_amp.where((F.col("reason") == "ok") & (F.col("snr").isNull() | (F.col("snr") >= min_snr)))
    return rows.withColumn("station", C.epoch_station(F.col("station"), F.col("epoch"))) if epoch_station else rows


def noise_floor(obs: DataFrame, least: float) -> DataFrame:
    return obs.where(F.col("log10A") >= least)


#: Stations whose counts are sent to every task of a round.
MOST_STATIONS = 5_000_000


def kcore_prune(obs: DataFrame, min_sta: int = 8, min_ev: int = 3, station: str = "station", event: str = "event_id", max_rounds: int = 200) -> DataFrame:
    """The largest part of ``obs`` where each station has ``min_sta`` rows and each event ``min_ev``; unique, so order is of no matter.

    Which stations are left decides which events are, so a round only counts each station's rows: an event's stations are packed once, a task
    gets the stations that are left and gives back their counts, and rows move once, at the end.
    """
    rows = obs.where(F.col(station).isNotNull() & F.col(event).isNotNull())
    names = cut(rows.groupBy(F.col(station).alias("_s")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sta).select("_s"))
    size = names.count()
    if size > MOST_STATIONS:
        return _prune_rows(rows, min_sta, min_ev, station, event, max_rounds)
    numbers = [T.StructField("_s", obs.schema[station].dataType), T.StructField("_i", T.IntegerType())]
    stations = [r["_s"] for r in names.collect()]
    index = small(obs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(stations)], T.StructType(numbers)), MOST_STATIONS)
    slim = rows.select(F.col(event).alias("_e"), F.col(station).alias("_s")).join(index, "_s")
    packed = cut(slim.groupBy("_e").agg(F.collect_list("_i").alias("i")).where(F.size("i") >= min_ev).select("i"))
    left = np.ones(size, bool)
    for _ in range(max_rounds):

        def counted(batches: Iterator[pa.RecordBatch], left: np.ndarray = left) -> np.ndarray:
            total = np.zeros(size)
            for batch in batches:
                lists = batch.column("i")
                i, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                own = np.repeat(np.arange(len(n)), n)
                stays = np.bincount(own, weights=left[i], minlength=len(n)) >= min_ev
                total += np.bincount(i[left[i] & stays[own]], minlength=size)
            return total

        good = left & (summed(packed, size, counted) >= min_sta) if size else left
        if (good == left).all():
            break
        left = good
    else:
        raise RuntimeError("pruning did not settle")
    kinds = T.StructType([T.StructField(station, obs.schema[station].dataType)])
    alive = small(obs.sparkSession.createDataFrame([(x,) for x, there in zip(stations, left) if there], kinds), MOST_STATIONS)
    own = rows.join(alive, station, "left_semi")
    good = own.groupBy(event).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_ev).select(event)
    return own.join(good, event, "left_semi").select(*obs.columns)


def _prune_rows(obs: DataFrame, min_sta: int, min_ev: int, station: str, event: str, max_rounds: int) -> DataFrame:
    """``kcore_prune`` for more stations than a task is sent: rows move in each round."""
    own, n = obs, obs.count()
    for _ in range(max_rounds):
        good = own.groupBy(station).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sta).select(station)
        own = own.join(good, station, "left_semi")
        good = own.groupBy(event).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_ev).select(event)
        own = cut(own.join(good, event, "left_semi"))
        now = own.count()
        if now == n:
            return own.select(*obs.columns)
        n = now
    raise RuntimeError("pruning did not settle")


def reject_mad(obs: DataFrame, k: float = 4.0, column: str = "resid") -> DataFrame:
    """Rows whose residual is within k scaled MADs; all rows where that is zero or undefined."""
    dev = mad(obs, column).select(F.col("mad").alias("_mad"))
    rows = obs.crossJoin(F.broadcast(dev))  # one row
    return rows.where(F.col("_mad").isNull() | F.isnan("_mad") | (F.col("_mad") <= 0) | (F.abs(column) <= k * F.col("_mad"))).drop("_mad")


def residuals(obs: DataFrame, mags: DataFrame, terms: DataFrame, coeffs: dict[str, float]) -> DataFrame:
    """``obs`` with each row's own magnitude ``m_sta`` and its residual."""
    loss = F.lit(None).cast("double")
    for phase in {k.split("|")[1] for k in coeffs}:
        loss = F.when(F.col("phase") == phase, attenuation("dist_hypo_km", coeffs.get(f"n|{phase}", 0.0), coeffs.get(f"k|{phase}", 0.0))).otherwise(loss)
    rows = obs.join(terms.select("station", "phase", "C"), ["station", "phase"], "left").join(mags, "event_id", "left")
    rows = rows.withColumn("m_sta", F.col("log10A") - F.coalesce("C", F.lit(0.0)) + loss)
    return rows.withColumn("resid", F.col("m_sta") - F.col("M_rel"))


def event_magnitudes(resid: DataFrame) -> DataFrame:
    """Per event: magnitude, numbers of observations, scatter and standard error (null for one), place of the first row by station."""
    first = F.struct("station", "phase")
    out = resid.groupBy("event_id").agg(
        F.first("M_rel").alias("M_rel"), F.count(F.lit(1)).alias("n_obs"), F.count_if(F.col("phase") == "P").alias("n_P"), F.count_if(F.col("phase") == "S").alias("n_S"),
        F.stddev_samp("m_sta").alias("M_sta_std"), *[F.min_by(c, first).alias(c) for c in ("evla", "evlo", "evdp") if c in resid.columns],
    )
    return out.withColumn("M_rel_sem", F.col("M_sta_std") / F.sqrt("n_obs"))


def calibrate(events: DataFrame, coeffs: DataFrame, column: str = "M_rel", spread: float = 0.0) -> DataFrame:
    """``ml`` = slope times the relative magnitude plus intercept, and its uncertainty with the fit's spread."""
    c = coeffs.select(F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    out = events.crossJoin(F.broadcast(c)).withColumn("ml", F.col("_s") * F.col(column) + F.col("_i"))
    sem = F.coalesce(F.col("M_rel_sem"), F.lit(0.0)) if "M_rel_sem" in events.columns else F.lit(0.0)
    return out.withColumn("ml_unc", F.hypot(F.col("_s") * sem, F.lit(spread))).drop("_s", "_i")


def to_mw(ml, a: float = 1.7, b: float = 0.8):
    return a + b * ml


def marker_scale(events: DataFrame, picks: str = "picks") -> DataFrame:
    """log10 of the number of picks from 0 to 1 over the whole catalogue."""
    ends = events.agg(F.min(F.log10(picks)).alias("_a"), F.max(F.log10(picks)).alias("_b"))
    return events.crossJoin(F.broadcast(ends)).withColumn("marker", F.when(F.col("_b") > F.col("_a"), (F.log10(picks) - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.lit(1.0))).drop("_a", "_b")

