"""Interval joins by dyadic keys.

An epoch is put under the one or two spans of a power-of-two length, no shorter than itself, that it reaches into; a time under the span of every such
length in use that it falls in. So they meet by equality, a station of many epochs is dealt out over time, and only near misses are
tested in vain. Results are found for the distinct keys and times of the rows and joined back by these, never by a generated row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans are counted in units of 2**20 microseconds, about a second.
UNIT = 20
#: Longer epochs, and those without an end, are under one span.
ENDLESS = 43


def _ticks(time: Column, kind: str) -> Column:
    """Whole units since 1970 of a date, timestamp or number of seconds."""
    micros = F.unix_date(time).cast("long") * 86_400_000_000 if kind == "date" else F.unix_micros(time.cast("timestamp")) if kind.startswith("timestamp") else F.floor(time.cast("double") * 1_000_000).cast("long")
    return F.shiftright(micros, UNIT)


def _shift(value: str, level: str) -> Column:
    return F.expr(f"shiftright({value}, {level})")


def containing(times: DataFrame, epochs: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """All pairs of a (distinct ``key, time``) row and an epoch of that key with start <= time < end; an open end never ends.

    ``epochs`` has the key as ``key`` and no other column of the times' names. Null keys, times and starts match nothing.
    """
    t_kind, s_kind, e_kind = dict(times.dtypes)[time], dict(epochs.dtypes)[start], dict(epochs.dtypes)[end]
    a, b = _ticks(F.col(start), s_kind), _ticks(F.col(end), e_kind)
    spans = epochs.where(F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    spans = spans.withColumn("_a", a).withColumn("_b", b)
    length = F.ceil(F.log2(F.greatest(F.lit(1), F.col("_b") - F.col("_a") + 1))).cast("int")
    spans = spans.withColumn("_level", F.when(F.col("_b").isNull() | (length > ENDLESS - 1), F.lit(ENDLESS)).otherwise(length))
    first, last = _shift("_a", "_level"), _shift("_b", "_level")
    at = F.when(F.col("_level") == ENDLESS, F.array(F.lit(0).cast("long"))).when(first == last, F.array(first)).otherwise(F.array(first, last))
    spans = spans.withColumn("_span", F.explode(at)).drop("_a", "_b")
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # at most 44
    if not levels:
        return times.join(spans.drop("_level", "_span"), key).where("false")
    points = times.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_t", _ticks(F.col(time), t_kind))
    points = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    points = points.withColumn("_span", F.when(F.col("_level") == ENDLESS, F.lit(0).cast("long")).otherwise(_shift("_t", "_level"))).drop("_t")
    inside = (F.col(start) <= F.col(time)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return points.join(spans, [key, "_level", "_span"]).where(inside).drop("_level", "_span")


def interval_join(rows: DataFrame, epochs: DataFrame, key: str, time: str) -> DataFrame:
    """Each row with the epoch (``start_date, end_date`` and all else as ``epoch_*``) that holds its time, start included, end not; an open end never ends.

    Of several the earliest start wins, then the smallest other columns. Every row stays, whether repeated or with a null key or time.
    """
    e = epochs.select(*[F.col(c).alias(c if c == key else f"epoch_{c}") for c in epochs.columns])
    own = [c for c in e.columns if c != key]
    order = ["epoch_start_date", *[c for c in own if c != "epoch_start_date"]]
    # Of the epochs of a station that never end only the first can win: it holds whatever a later one holds.
    endless = e.where("epoch_end_date is null and epoch_start_date is not null").groupBy(key).agg(F.min(F.struct(*order)).alias("_e")).select(key, *[F.col(f"_e.{c}").alias(c) for c in own])
    e = e.where("epoch_end_date is not null").select(key, *own).unionByName(endless.select(key, *own))
    found = containing(rows.select(key, time).distinct(), e, key, time, "epoch_start_date", "epoch_end_date")
    best = found.groupBy(F.col(key).alias("_k"), F.col(time).alias("_t")).agg(F.min(F.struct(*order)).alias("_e"))
    hit = rows.join(best, (rows[key] == best["_k"]) & (rows[time] == best["_t"]), "left")
    return hit.select(*[rows[c] for c in rows.columns], *[F.col(f"_e.{c}").alias(c) for c in own])


#: What an inventory tells of a station at a time, from its channel codes.
FLAGS = {"has_vertical": "channel like '%Z'", "has_horizontal": "channel rlike '[EN12]$'", "has_hh": "channel like 'HH%'", "has_bh": "channel like 'BH%'", "has_eh": "channel like 'EH%'"}


def availability_at(picks: DataFrame, inventory: DataFrame, key: str = "station", time: str = "time") -> DataFrame:
    """``picks`` with flags of the channels that run at each pick's station and time; false where none does.

    ``inventory``: the key, channel, start_date, end_date. Epochs of one kind that touch or overlap count as they are.
    """
    flags = {n: F.expr(e) for n, e in FLAGS.items()}
    kinds = inventory.select(F.col(key), F.col("start_date").alias("_start"), F.col("end_date").alias("_end"), *[F.coalesce(e, F.lit(False)).alias(n) for n, e in flags.items()]).distinct()
    found = containing(picks.select(key, time).distinct(), kinds, key, time, "_start", "_end")
    at = found.groupBy(F.col(key).alias("_k"), F.col(time).alias("_t")).agg(*[F.bool_or(n).alias(n) for n in FLAGS])
    hit = picks.drop(*FLAGS).join(at, (picks[key] == at["_k"]) & (picks[time] == at["_t"]), "left")
    return hit.drop("_k", "_t").withColumns({n: F.coalesce(n, F.lit(False)) for n in FLAGS})
