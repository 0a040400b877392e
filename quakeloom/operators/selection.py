"""Selections of events, picks and stations, and the plain joins beside them. Rows whose value is null do not pass, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import small


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def time_window(df: DataFrame, time: str, start=None, end=None, closed: str = "both") -> DataFrame:
    """Rows between two times, either of which may be open (None). ``closed``: both, left, right or neither."""
    t, parts = F.col(time), [F.col(time).isNotNull()]
    if start is not None:
        parts.append(t >= F.lit(start) if closed in ("both", "left") else t > F.lit(start))
    if end is not None:
        parts.append(t <= F.lit(end) if closed in ("both", "right") else t < F.lit(end))
    return df.where(_all(parts))


def around(df: DataFrame, pivots: DataFrame, time: str, seconds: float) -> DataFrame:
    """Rows within so many seconds of a pivot's ``time`` (both in seconds, ends included), with its other columns as ``pivot_*``."""
    p = pivots.select(*[F.col(c).alias(f"pivot_{c}") for c in pivots.columns])
    bucket = F.floor(F.col(f"pivot_{time}") / seconds)
    p = p.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    rows = df.withColumn("_b", F.floor(F.col(time) / seconds)).join(p, "_b")
    return rows.where(F.abs(F.col(time) - F.col(f"pivot_{time}")) <= seconds).drop("_b")


def box_of(df: DataFrame, columns: list[str], pad: dict[str, float] | None = None) -> DataFrame:
    """One row with the least and the greatest of each column, ``low_*`` and ``high_*``, widened by ``pad``."""
    pad = pad or {}
    wide = lambda f, c, s: f(c) + s * F.lit(pad[c]) if c in pad else f(c)
    return df.agg(*[e for c in columns for e in (wide(F.min, c, -1).alias(f"low_{c}"), wide(F.max, c, 1).alias(f"high_{c}"))])


def inside_box_of(df: DataFrame, other: DataFrame, columns: list[str], pad: dict[str, float] | None = None) -> DataFrame:
    """Rows inside the box that another table's rows span in these columns, its edges included. Nothing is inside the box of no rows."""
    box = box_of(other, columns, pad)
    rows = df.join(F.broadcast(box), _all([F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}")) for c in columns]))  # one row
    return rows.select(*df.columns)


def without(df: DataFrame, denied: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the deny-list; rows with a null key stay."""
    return df.join(denied.select(*keys), keys, "left_anti")


def only(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in the allow-list."""
    return df.join(allowed.select(*keys), keys, "left_semi")


def without_sentinels(df: DataFrame, column: str, above: float = -5.0) -> DataFrame:
    """Rows whose value is greater than what marks a missing one."""
    return df.where(F.col(column) > above)


def of_types(df: DataFrame, column: str, types: list[str]) -> DataFrame:
    """Rows of these magnitude types, whatever their case and blanks around them."""
    return df.where(F.lower(F.trim(column)).isin([t.lower() for t in types]))


def first_magnitude(df: DataFrame, magnitudes: str, types: list[str] = ("ml", "mlv"), name: str = "ml") -> DataFrame:
    """``df`` with the first magnitude of an accepted type in an array of (mag_type, mag); events without one go."""
    good = F.filter(magnitudes, lambda m: F.lower(m["mag_type"]).isin(list(types)) & m["mag"].isNotNull())
    return df.withColumn(name, F.get(good, F.lit(0))["mag"]).where(F.col(name).isNotNull())


def depth_band(df: DataFrame, low: float | None, high: float | None, column: str = "depth") -> DataFrame:
    """low <= depth < high; None is no bound."""
    return time_window(df, column, low, high, "left")


def least_picks(df: DataFrame, n: int = 6, column: str = "picks") -> DataFrame:
    return df.where(F.col(column) >= n)


def scaled_matches(matches: DataFrame, bounds: tuple[float, ...] = (0.1, 0.2, 2**0.5), metric: str = "metric") -> DataFrame:
    """``bound, n, share``: how many nearest matches lie below each scaled distance."""
    total = F.count(F.lit(1))
    counts = matches.agg(total.alias("_t"), *[F.count_if(F.col(metric) < b).alias(f"_{k}") for k, b in enumerate(bounds)])
    rows = counts.select("_t", F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"_{k}").alias("n")) for k, b in enumerate(bounds)])).alias("x"))
    return rows.select("x.bound", "x.n", F.when(F.col("_t") > 0, F.col("x.n") / F.col("_t")).alias("share"))


def sampled_faster(df: DataFrame, hz: float = 10.0, column: str = "fs") -> DataFrame:
    return df.where(F.col(column) > hz)


def failed_with(df: DataFrame, text: str, column: str = "reason") -> DataFrame:
    """Rows whose failure text holds ``text``."""
    return df.where(F.contains(F.col(column), F.lit(text)))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_df1", "_df2")) -> DataFrame:
    """Rows of two tables that agree in the keys, one for each pair; columns that both have get a suffix."""
    both = {c for c in a.columns if c in b.columns} - set(keys)
    named = lambda df, s: df.withColumnsRenamed({c: c + s for c in df.columns if c in both})
    return named(a, suffixes[0]).join(named(b, suffixes[1]), keys)


def same_station_origin(rows: DataFrame, picks: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """``rows`` (sta, origin_s) joined with the picks (sta, otime, ...) at their station whose origin time differs by less than the tolerance."""
    bucket = F.floor(F.col("origin_s") / tolerance_s)
    r = rows.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    p = picks.withColumn("_b", F.floor(F.col("otime") / tolerance_s))
    return r.join(p, ["sta", "_b"]).where(F.abs(F.col("otime") - F.col("origin_s")) < tolerance_s).drop("_b")


def with_first_start(stations: DataFrame, epochs: DataFrame, key: str = "station") -> DataFrame:
    """``stations`` with the earliest ``start_date`` of their epochs, null where there is none."""
    first = epochs.groupBy(key).agg(F.min("start_date").alias("start_date"))
    return stations.drop("start_date").join(small(first), key, "left")


def redeployed(epochs: DataFrame, key: str = "station") -> DataFrame:
    """``key, starts``: stations with more than one different start."""
    return epochs.groupBy(key).agg(F.count_distinct("start_date").alias("starts")).where("starts > 1")
