"""Projections and schema repair: names, codes, times, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Without the columns that an index leaves behind in a CSV file."""
    return df.drop(*[c for c in df.columns if c == "_c0" or c.startswith("Unnamed: 0")])


def find_column(df: DataFrame, keywords: list[str]) -> str | None:
    """The first column whose name holds one of the keywords, keywords in order of preference; no data is read."""
    for k in keywords:
        for c in df.columns:
            if k.lower() in c.lower():
                return c
    return None


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def select_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def flip_station(code: Column) -> Column:
    """``STA.NET`` becomes ``NET.STA``; blanks around either go."""
    return F.concat_ws(".", F.reverse(F.transform(F.split(F.trim(code), r"\."), F.trim)))


def network(code: Column) -> Column:
    return F.split(code, r"\.")[0]


def station(code: Column) -> Column:
    return F.get(F.split(code, r"\."), F.lit(1))


def station_id(net: Column, sta: Column) -> Column:
    return F.concat(net, F.lit("."), sta, F.lit("."))


def epoch_station(code: Column, epoch: Column) -> Column:
    """``NET.STA@epoch``; the plain code where there is no epoch."""
    return F.when(F.coalesce(epoch, F.lit("")) != "", F.concat_ws("@", code, epoch)).otherwise(code)


def phase_code(raw: Column) -> Column:
    """0, P, p become P; 1, S, s become S; blanks go; anything else is null."""
    code = F.upper(F.trim(raw.cast("string")))
    return F.when(code.isin("0", "P"), "P").when(code.isin("1", "S"), "S")


def number(raw: Column) -> Column:
    """A double; text that is none, and not-a-number, are null."""
    value = raw.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_time(raw: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(raw, F.lit(fmt)) if fmt else F.try_to_timestamp(raw)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def time_of_either(df: DataFrame, column: str) -> DataFrame:
    """A column of epoch seconds or of ISO times; which, is decided for the whole column."""
    text = F.col(column).cast("string")
    bad = df.agg(F.count_if(text.isNotNull() & text.try_cast("double").isNull()).alias("bad")).first()[0]
    return df.withColumn(column, to_time(text) if bad else from_epoch(text.try_cast("double")))


def day_and_second(day: Column, second: Column) -> Column:
    return F.date_trunc("day", day) + F.make_dt_interval(secs=second.cast("decimal(18,6)"))


def depth_from_metres(z: Column) -> Column:
    """Metres upwards to kilometres downwards."""
    return -z / 1000


def unpivot_arrivals(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each arrival that is there: ``keep``, phase, time."""
    rows = df.select(*keep, F.col("trace_p_arrival").alias("P"), F.col("trace_s_arrival").alias("S"))
    return rows.unpivot(keep, ["P", "S"], "phase", "time").where("time is not null")


def row_ids(df: DataFrame, order: list[str], name: str = "pick_id", start: int = 0) -> DataFrame:
    """Consecutive ids in the order given. Rows are dealt out by range and written; ranges are counted first, then rows within theirs."""
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    rows = ranged.join(F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))), "_part")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn(name, (F.col("_before") + at - 1 + start).cast("long")).drop("_part", "_before")


def dense_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """The dense rank of a column's values, from 0: distinct values are numbered and joined back."""
    numbered = row_ids(df.select(F.col(column).alias("_v")).where("_v is not null").distinct(), ["_v"], name)
    return df.join(numbered, df[column] == numbered["_v"], "left").drop("_v")


def coded_id(prefix: str, number_col: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number_col.cast("string"), width, "0"))


def event_code(time: Column) -> Column:
    """``ev`` and the origin time, dots as underscores."""
    return F.concat(F.lit("ev"), F.regexp_replace(time.cast("string"), r"\.", "_"))


def graft_by_position(df: DataFrame, other: DataFrame, order: list[str], other_order: list[str], columns: list[str]) -> DataFrame:
    """Columns of a table of equal length, row by row in the declared orders; unequal lengths are an error."""
    if df.count() != other.count():
        raise ValueError("the tables differ in length")
    left, right = row_ids(df, order, "_row"), row_ids(other, other_order, "_row").select("_row", *columns)
    return left.drop(*columns).join(right, "_row").drop("_row")


def elapsed_text(seconds: Column) -> Column:
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)")).cast("string")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded half to even."""
    return df.withColumns({c: F.bround(c, n) for c, n in digits.items()})
