"""The relational catalogue: arrivals, associations and origins, their geometry and quality gate, and de-duplication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.geodesic import inverse
from ..functions.lineage import cut, shared_path
from .match import candidates, nearest_k, small
from .order_stats import greatest_before

ALGORITHM = "genie"
#: Arrivals that one task joins and adds up by event.
PER_TASK = 1_000_000


def normalize_reloc(catalog: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and picks of a relocation's files with plain names, times, station codes and phases."""
    e = C.strip_headers(C.strip_headers(catalog)).withColumnsRenamed({"Latitude": "lat", "Longitude": "lon", "Depth (km)": "depth", "Origin Time (UTC)": "time", "Event ID": "orid", "Num. P": "p_picks", "Num. S": "s_picks", "RMS Residual (s)": "rms", "Detection Value": "detection"})
    p = C.strip_headers(picks).withColumnsRenamed({"Pick Time (UTC)": "pick_time", "Station Name": "sta", "Phase Type": "phase", "Residual (s)": "timeres", "Event ID": "orid", "Pick ID": "arid"})
    e = e.withColumn("time", C.to_time(F.trim(F.col("time").cast("string"))))
    return e, p.withColumn("pick_time", C.to_time(F.trim(F.col("pick_time").cast("string")))).withColumn("sta", C.flip_station(F.col("sta"))).withColumn("phase", C.phase_code(F.col("phase")))


def assignments(picks: DataFrame, events: DataFrame, stations: DataFrame) -> DataFrame:
    """Picks with their event and station; picks of unknown events or stations stay."""
    return picks.join(events, "orid", "left").join(small(stations.select(F.col("station").alias("sta"), F.col("latitude").alias("slatitude"), F.col("longitude").alias("slongitude"), F.col("elevation").alias("selevation"))), "sta", "left")


def build_arrival(assign: DataFrame) -> DataFrame:
    return assign.select("arid", "sta", F.col("phase").alias("iphase"), C.to_epoch(F.col("pick_time")).alias("time"), "prob")


def build_assoc(assign: DataFrame) -> DataFrame:
    return assign.select("arid", "orid", "sta", "phase", "prob", "timeres", "slatitude", "slongitude", "selevation")


def build_origin(assign: DataFrame) -> DataFrame:
    """One row for each event, the first by pick; numbers of picks follow from ``event_geometry``."""
    first = keep_first(assign.where("orid is not null"), ["orid"], ["arid"])
    return first.select("orid", "lat", "lon", "depth", C.to_epoch(F.col("time")).alias("time"), "p_picks", "s_picks", "rms", F.lit(ALGORITHM).alias("algorithm"))


def denormalize(arrival: DataFrame, assoc: DataFrame, origin: DataFrame) -> DataFrame:
    """Every arrival with its association and origin, if any; shared columns come from the arrival, then the association."""
    a = assoc.drop(*[c for c in arrival.columns if c != "arid"])
    o = origin.drop(*[c for c in (*arrival.columns, *a.columns) if c != "orid"])
    return arrival.join(a, "arid", "left").join(o, "orid", "left")


def azimuthal_gap(azimuth: Column, single: str = "zero") -> Column:
    """The widest gap between sorted azimuths of a group, round the circle; one azimuth: 0, or 360 with ``full``."""
    a = F.array_sort(F.collect_list(azimuth))
    gaps = F.transform(F.sequence(F.lit(1), F.array_size(a) - 1), lambda i: F.get(a, i) - F.get(a, i - 1))
    wrap = 360 + F.array_min(a) - F.array_max(a)
    one = F.lit(0.0 if single == "zero" else 360.0)
    return F.when(F.array_size(a) == 0, F.lit(None)).when(F.array_size(a) == 1, one).otherwise(F.greatest(F.array_max(gaps), wrap))


def event_geometry(assoc: DataFrame, origin: DataFrame, gap_single: str = "zero") -> tuple[DataFrame, DataFrame]:
    """Associations with delta (degrees of 6371 km), esaz and seaz on the ellipsoid; origins with nass, nsphz and gap.

    seaz is the azimuth at the station of the way to the event, esaz the opposite direction. An event at its station has seaz 0, so esaz 180. Picks without station coordinates stay in
    the first and are left out of the gap.
    """
    o = origin.select("orid", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    a = assoc.join(o, "orid", "left").withColumn("_g", inverse("_la", "_lo", "slatitude", "slongitude"))
    a = a.withColumn("delta", F.col("_g.km") / (np.pi * 6371.0 / 180)).withColumn("esaz", F.pmod(F.col("_g.baz") + 180, F.lit(360.0))).withColumn("seaz", F.col("_g.baz")).drop("_la", "_lo", "_g")
    per = a.groupBy("orid").agg(F.count(F.lit(1)).alias("nass"), F.count_if(F.col("phase") == "S").alias("nsphz"), azimuthal_gap(F.when(F.col("slatitude").isNotNull(), F.col("esaz")), gap_single).alias("gap"))
    return a, origin.join(per, "orid", "left")


def arrival_summary(arrivals: DataFrame, origins: DataFrame) -> DataFrame:
    """Of each ``sta, iphase``: ``n`` arrivals, ``events`` (distinct orid), ``mean_depth`` of their origins and the sum of ``amp``.

    Arrivals and origins are dealt out by event, at most about PER_TASK arrivals to a task, and added up there before stations meet.
    """
    parts = max(int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(arrivals.count() / PER_TASK))
    rows = arrivals.repartition(parts, "orid").join(origins.select("orid", "depth").repartition(parts, "orid"), "orid", "left")
    own = rows.groupBy("orid", "sta", "iphase").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("d"), F.count("depth").alias("nd"), F.sum("amp").alias("amp"))
    mean = F.when(F.sum("nd") > 0, F.sum("d") / F.sum("nd"))
    return own.groupBy("sta", "iphase").agg(F.sum("n").alias("n"), F.count("orid").alias("events"), mean.alias("mean_depth"), F.sum("amp").alias("amp"))


def phase_counts(assoc: DataFrame, key: str = "orid") -> DataFrame:
    return assoc.groupBy(key).agg(F.count_if(F.col("phase") == "P").alias("p_picks"), F.count_if(F.col("phase") == "S").alias("s_picks"), F.count(F.lit(1)).alias("picks"))


def qc_gate(origin: DataFrame, min_p: int = 4, min_s: int = 4, max_rms: float = 2.5, flag_only: bool = False) -> DataFrame:
    """Origins with enough P and S picks and a residual strictly below the bound; or all, with ``qc_pass``."""
    ok = F.coalesce((F.col("p_picks") >= min_p) & (F.col("s_picks") >= min_s) & (F.col("rms") < max_rms), F.lit(False))
    return origin.withColumn("qc_pass", ok) if flag_only else origin.where(ok)


def well_constrained(origin: DataFrame, max_gap: float = 180, min_s: int = 6) -> DataFrame:
    return origin.where((F.col("gap") < max_gap) & (F.col("nsphz") >= min_s) & (F.col("depth") > 0))


def station_geometry_ok(picks: DataFrame, near_km: float = 50, min_near: int = 2, max_jump: float = 100) -> DataFrame:
    """Event ids with enough stations nearby and no jump between successive distances beyond the bound. ``picks``: id, dist."""
    jumped = picks.withColumn("jump", F.col("dist") - F.lag("dist").over(Window.partitionBy("id").orderBy("dist")))
    ok = jumped.groupBy("id").agg(F.count_if(F.col("dist") <= near_km).alias("n"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("j"))
    return ok.where((F.col("n") >= min_near) & (F.col("j") <= max_jump)).select("id")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def mark_repeats(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("is_repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def union_catalogs(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Segments put together by name, one row for each key: the earlier segment's, then the first in order."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("_segment", F.lit(n))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, keys, ["_segment", *order]).drop("_segment")


def coverage_check(expected: DataFrame, done: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, unexpected or repeated among results and errors, with ``problem``."""
    seen = done.select(*keys).unionByName(errors.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = expected.select(*keys).distinct().join(seen, keys, "left_anti").withColumn("problem", F.lit("missing"))
    odd = seen.join(expected.select(*keys), keys, "left_anti").select(*keys).withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(odd).unionByName(seen.where("n > 1").select(*keys).withColumn("problem", F.lit("repeated")))


def greedy_walk(rows: pd.DataFrame, dt_s: float, dist_km: float) -> np.ndarray:
    """Which rows, in order of time, stay: one stays unless an earlier kept one is within both bounds."""
    t, lat, lon = (rows[c].to_numpy(float) for c in ("time_s", "lat", "lon"))
    keep, a, o = np.ones(len(rows), bool), np.radians(lat), np.radians(lon)
    c, reach = np.cos(a), t + dt_s
    # Where the times within dt_s end, or a rounding error later: a kept row drops all it reaches at once.
    ends = np.searchsorted(t, reach + 1e-15 * (np.abs(reach) + abs(dt_s)), "right")
    for i in range(len(rows)):
        if keep[i] and ends[i] > i + 1:
            k = slice(i + 1, ends[i])
            h = np.sin((a[k] - a[i]) / 2) ** 2 + c[k] * c[i] * np.sin((o[k] - o[i]) / 2) ** 2
            keep[k] &= (t[k] - t[i] > dt_s) | ~(2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h))) <= dist_km)
    return keep


def dedupe_events(events: DataFrame, dt_s: float = 10, dist_km: float = 25, max_session: int = 20_000) -> DataFrame:
    """Greedy de-duplication in order of (time, lat, lon, id): a kept event drops all others within both bounds.

    Time gaps over ``dt_s`` part the events into independent sessions, each walked apart. Sessions over
    ``max_session`` events are cut into slices of time that are walked side by side (``_slices``), or, where ``dt_s`` alone holds too many
    events for a walk, settled in rounds on their conflict pairs: an event without an earlier undecided or kept
    neighbour stays and its neighbours go. All give the walk's result.
    """
    e = events.where("time_s is not null and lat is not null and lon is not null")
    # The event before each one, found within a time bucket and the bucket before: no global order is needed.
    width = 64 * dt_s
    own = e.select("id", "time_s").withColumn("b", F.floor(F.col("time_s") / width))
    late = own.select((F.col("b") + 1).alias("b"), "time_s").groupBy("b").agg(F.max("time_s").alias("carried"))
    by = Window.partitionBy("b").orderBy("time_s", "id")
    starts = own.withColumn("p", F.lag("time_s").over(by)).join(late, "b", "left").withColumn("p", F.coalesce("p", "carried"))
    starts = starts.where(F.col("p").isNull() | (F.col("time_s") - F.col("p") > dt_s)).select("b", F.col("time_s").alias("start"))
    # A session is named by its first time; a bucket without a start goes on with the last one before it.
    firsts = starts.groupBy("b").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    buckets = own.select("b").distinct().join(firsts, "b", "left").withColumn("last", F.array_max("starts"))
    carried = greatest_before(buckets, "b", "last", "before")
    placed = e.withColumn("b", F.floor(F.col("time_s") / width)).join(carried.select("b", "starts", "before"), "b")
    session = F.coalesce(F.array_max(F.filter("starts", lambda s: s <= F.col("time_s"))), F.col("before"))
    placed = placed.withColumn("session", session).drop("b", "starts", "before")
    sizes = placed.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > max_session).select("session")
    large = cut(large)  # at most one of ``max_session`` events

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time_s", "lat", "lon", "id"], ignore_index=True)
        return rows.loc[greedy_walk(rows, dt_s, dist_km), ["id"]]

    slim = placed.select("id", "time_s", "lat", "lon", "session")
    # Sessions that start near each other are walked in one call; the walk itself does not cross their gaps.
    together = F.floor(F.col("session") / (1024 * dt_s))
    kept = slim.join(large, "session", "left_anti").groupBy(together).applyInPandas(walk, f"id {dict(events.dtypes)['id']}")
    if not large.isEmpty():
        kept = kept.unionByName(_slices(slim.join(large, "session", "left_semi").drop("session"), dt_s, dist_km))
    return events.join(kept, "id", "left_semi")


#: Events of a slice of time that is walked in one call, and the times ``dt_s`` that it lasts where there are cores for shorter ones.
SLICE_EVENTS, SLICE_LENGTH = 200_000, 64


def _slices(events: DataFrame, dt_s: float, dist_km: float) -> DataFrame:
    """Ids of the events that the greedy walk keeps, by slices of time no shorter than ``dt_s``.

    A slice's walk depends on what is kept in the last ``dt_s`` of the slice before. All slices are walked as if that were none, then those again
    whose beginning is not the one they were walked with, until there is none. The first slice is right at once and each one when its
    beginning is. Sparse events soon forget how a walk began; dense ones may never, and then each round settles a slice. So slices are as
    long as a walk can be, a round reads those it walks alone, and only slice numbers with a digest of their ends come to the driver.
    """
    spark = events.sparkSession
    events = cut(events)
    windows = events.groupBy(F.floor(F.col("time_s") / dt_s)).agg(F.count(F.lit(1)).alias("n"))
    most, total, lasting = (x or 0 for x in windows.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first())
    if most > SLICE_EVENTS or dt_s <= 0:
        return _rounds(events, dt_s, dist_km)
    cores = spark.sparkContext.defaultParallelism
    slices = max(1, math.ceil(total / SLICE_EVENTS), min(4 * cores, math.ceil(lasting / SLICE_LENGTH)))
    slim = events.select("id", "time_s", "lat", "lon")
    kind = ", ".join(f"{c} {t}" for c, t in slim.dtypes)
    rows, found = shared_path(spark, "slices"), shared_path(spark, "kept")
    ranges = slim.withColumn("w", F.floor(F.col("time_s") / dt_s)).repartitionByRange(slices, "w").drop("w")
    ranges.withColumn("slice", F.spark_partition_id()).write.partitionBy("slice").parquet(rows)

    def read(path: str, folders: list[str], schema: str) -> DataFrame:
        return spark.read.schema(schema).option("basePath", path).parquet(*folders)

    def walked(slices: list[int]) -> DataFrame:
        return read(found, [f"{found}/turn={last[s]}/slice={s}" for s in slices], f"{kind}, own boolean, tail boolean, turn int, slice int").drop("turn")

    def walk(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return own.assign(own=False, tail=False)
        both = [x.sort_values(["time_s", "lat", "lon", "id"]) for x in (before, own)]
        # All that was kept before is kept again: nothing in it is near another.
        order = pd.concat([x for x in both if len(x)], ignore_index=True).assign(slice=own["slice"].iloc[0])
        keep, late = greedy_walk(order, dt_s, dist_km), order["time_s"] >= order["time_s"].iloc[-1] - dt_s * 1.001
        order = order.assign(own=keep & (order.index >= len(before)), tail=keep & late)
        keep[-1] = True  # a row at least, so that there is a folder
        return order.loc[keep]

    there = [r[0] for r in read(rows, [rows], f"{kind}, slice int").select("slice").distinct().orderBy("slice").collect()]
    before = dict(zip(there[1:], there, strict=False))
    used, ends, last, todo, turn = {}, {}, {}, there, 0
    while todo:
        begun = [(before[s], s) for s in todo if ends.get(before.get(s))]
        begins = slim.limit(0).withColumn("slice", F.lit(0))
        if begun:
            after = F.broadcast(spark.createDataFrame(begun, "slice int, next int"))  # a row for each slice at most
            begins = walked([s for s, _ in begun]).where("tail").join(after, "slice").select(*slim.columns, F.col("next").alias("slice"))
        own = read(rows, [f"{rows}/slice={s}" for s in todo], f"{kind}, slice int")
        both = [d.repartition(len(todo), "slice").groupBy("slice") for d in (own, begins)]
        kept = both[0].cogroup(both[1]).applyInPandas(walk, f"{kind}, slice int, own boolean, tail boolean")
        kept.withColumn("turn", F.lit(turn)).write.mode("append").partitionBy("turn", "slice").parquet(found)
        used |= {s: ends.get(before.get(s)) for s in todo}
        last |= dict.fromkeys(todo, turn)
        digest = F.sha2(F.to_json(F.sort_array(F.collect_list("id"))), 256)
        ends |= dict.fromkeys(todo) | {r[0]: r[1] for r in walked(todo).where("tail").groupBy("slice").agg(digest).collect()}
        changed = [s for s in there[1:] if ends[before[s]] != used[s]]
        turn += 1
        todo = changed if turn < 2 else changed[:cores]
    return walked(there).where("own").select("id")


def _rounds(events: DataFrame, dt_s: float, dist_km: float) -> DataFrame:
    order = lambda p: F.struct(*[F.col(f"{p}{c}") for c in ("time_s", "lat", "lon", "id")])
    edges = cut(candidates(events, events, dt_s, dist_km).where(order("ref_") < order("")).select(F.col("ref_id").alias("a"), F.col("id").alias("b")))
    left, kept = cut(events.select("id")), None
    while not left.isEmpty():
        live = edges.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi")
        stay = cut(left.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        gone = live.join(stay.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        kept = stay if kept is None else kept.union(stay)
        left = cut(left.join(stay, "id", "left_anti").join(gone, "id", "left_anti"))
    return kept


def nearest_stations(events: DataFrame, stations: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k + 1 nearest stations of each event with their rank, and the event's columns ``keep``; from cells that widen until they are proven nearest."""
    return nearest_k(events, stations, k + 1, "sta", metric="sphere", keep=keep).select("id", "sta", F.col("km").alias("dist"), "rank", *keep)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same ones each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def sample_with_replacement(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n draws of rows, each uniform over all."""
    numbered = C.row_ids(df, [key], "_row").persist()
    total = numbered.count()
    if not total:
        return df
    draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("_row"))
    return draws.join(numbered, "_row").drop("_row")


def slice_rows(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(count)
