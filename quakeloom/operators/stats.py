"""Statistics of a catalogue: summaries, histograms, frequency-magnitude, rates, robust fits and tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from .order_stats import beside, running_sums, with_quantiles
from .slopes import theil_sen  # noqa: F401  part of this module's interface


def summary(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Count, least, 1 %, median, 99 % and greatest; quantiles are exact, linear between ranks."""
    own = df.groupBy(*by).agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    return with_quantiles(own, df, column, {"p01": 0.01, "median": 0.5, "p99": 0.99}, by).select(*by, "n", "least", "p01", "median", "p99", "greatest")


def describe_by(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    own = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    return with_quantiles(own, df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by).select(*by, "n", "mean", "std", "least", "q1", "median", "q3", "greatest")


def mean_error(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, sample deviation and standard error; both null for one row."""
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), (F.stddev_samp(column) / F.sqrt(F.count(column))).alias("sem"))


def spread(df: DataFrame, x: str, y: str) -> DataFrame:
    """Population deviation and root mean square of y - x, and the correlation of both."""
    d = F.col(y) - F.col(x)
    return df.agg(F.stddev_pop(d).alias("std"), F.sqrt(F.avg(d * d)).alias("rms"), F.corr(x, y).alias("r"))


def mad(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """``median`` and ``mad``: 1.4826 times the median of the distances from the median. Both null for a group without values."""
    by = list(by)
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    med = cut(with_quantiles(groups, df, column, {"median": 0.5}, by).drop("_n"))
    away = beside(df.select(*by, column), med, by).select(*by, F.abs(F.col(column) - F.col("median")).alias("_d"))
    return with_quantiles(med, away, "_d", {"_m": 0.5}, by).select(*by, "median", (1.4826 * F.col("_m")).alias("mad"))


def monthly_rate(df: DataFrame, ts: str, fill: bool = True) -> DataFrame:
    """Rows for each calendar month; with ``fill`` the empty months between the first and the last, too."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("month", F.col(ts).cast("timestamp")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    if not fill:
        return counts
    months = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def stations_per_month(assoc: DataFrame, origin: DataFrame) -> DataFrame:
    rows = assoc.join(origin.select("orid", F.date_trunc("month", F.col("ts").cast("timestamp")).alias("month")), "orid")
    return rows.groupBy("month").agg(F.count_distinct("sta").alias("stations"))


def fixed_rate(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows for each bin of so many days, counted from midnight of the first row's day."""
    t = F.col(ts).cast("timestamp")
    first = df.agg(F.date_trunc("day", F.min(t)).alias("_t0"))
    step = days * 86_400
    bins = df.where(t.isNotNull()).crossJoin(F.broadcast(first)).withColumn("bin", F.floor((F.unix_micros(t) - F.unix_micros("_t0")) / F.lit(step * 1_000_000)))
    return bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin`` (from 0), ``n``, ``density``; left-closed bins, the last closed on both sides, values outside left out."""
    if low is None or high is None:
        low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long, density double")
    width = (high - low) / bins or 1.0
    inside = df.where(F.col(column).between(low, high))
    rows = inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("_t"))
    return rows.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def density_2d(df: DataFrame, x: str, y: str, w: float, h: float, hexagons: bool = False) -> DataFrame:
    """Counts by square cell; or by hexagon of width w in axial coordinates (h is not used then)."""
    if not hexagons:
        return df.groupBy(F.floor(F.col(x) / w).alias("ix"), F.floor(F.col(y) / h).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    size = w / math.sqrt(3)
    q, r = (math.sqrt(3) / 3 * F.col(x) - F.col(y) / 3) / size, (2 / 3 * F.col(y)) / size
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    iq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    ir = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return df.groupBy(iq.cast("long").alias("ix"), ir.cast("long").alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def slice_median(df: DataFrame, x: str, y: str, start: float, stop: float, width: float) -> DataFrame:
    """Median of y for slices of x that include both ends, so a value on an edge counts for two."""
    n = round((stop - start) / width)
    k = (F.col(x) - start) / width
    on_edge = F.floor(k) == k
    at = F.when(on_edge, F.array(F.floor(k) - 1, F.floor(k))).otherwise(F.array(F.floor(k)))
    rows = df.where(F.col(x).between(start, stop)).select(F.explode(at).alias("slice"), F.col(y).alias("_y")).where(F.col("slice").between(0, n - 1))
    return with_quantiles(rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), rows, "_y", {"median": 0.5}, ["slice"])


def fmd(df: DataFrame, mag: str, by: list[str] = (), dm: float = 0.1) -> DataFrame:
    """Frequency-magnitude: ``mbin`` (thousandths), ``n`` and ``cum``, the events from there up. Bins are whole thousandths, so edges are exact."""
    step = round(dm * 1000)
    b = (F.floor(F.round(F.col(mag) * 1000) / step) * step).cast("long")
    counts = df.where(F.col(mag).isNotNull()).groupBy(*by, b.alias("mbin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*by).orderBy(F.desc("mbin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("cum", F.sum("n").over(up))


def completeness(table: DataFrame, by: list[str] = (), corr: float = 0.0) -> DataFrame:
    """``mc``: the first bin of most events, plus the correction."""
    return table.groupBy(*by).agg((F.max_by("mbin", F.struct(F.col("n"), -F.col("mbin"))) / 1000 + corr).alias("mc"))


def b_value(df: DataFrame, mag: str, mc: DataFrame, by: list[str] = (), dm: float = 0.1, least: int = 2) -> DataFrame:
    """Aki-Utsu b from the mean above completeness, Shi-Bolt error and a; null for fewer than ``least`` events."""
    rows = df.join(mc, list(by)) if by else df.crossJoin(F.broadcast(mc))
    above = rows.where(F.col(mag) >= F.col("mc") - 1e-9)
    s = above.groupBy(*by).agg(F.first("mc").alias("mc"), F.count(F.lit(1)).alias("n"), F.avg(mag).alias("mean"), F.var_pop(mag).alias("var"))
    b = F.lit(math.log10(math.e)) / (F.col("mean") - (F.col("mc") - dm / 2))
    ok = F.col("n") >= least
    s = s.withColumn("b", F.when(ok, b))
    return s.withColumn("sigma", F.when(ok, 2.3 * F.col("b") * F.col("b") * F.sqrt(F.col("var") / (F.col("n") - 1)))).withColumn("a", F.when(ok, F.log10("n") + F.col("b") * F.col("mc"))).drop("mean", "var")


def least_squares_b(table: DataFrame, least: int = 50, by: list[str] = ()) -> DataFrame:
    """b from the line through log10 of the cumulative counts of ``least`` and more."""
    x, y = F.col("mbin") / 1000, F.log10("cum")
    return table.where(F.col("cum") >= least).groupBy(*by).agg((-F.regr_slope(y, x)).alias("b"), F.regr_intercept(y, x).alias("a"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 1, ties with the mean of theirs. Distinct values are ranked by ranges, so equal rows cost one and no task ranks all."""
    counts = running_sums(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_k")), column, {"_upto": "_k"})
    return df.join(counts.select(column, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name)), column)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation of two columns of binned or monthly data."""
    rows = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def ks_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples and the asymptotic p; counts of distinct values are what meets."""
    rows = a.select(F.col(column).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.col(column).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = rows.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    steps = running_sums(counts, "x", {"ca": "a", "cb": "b"}).crossJoin(F.broadcast(total))
    d = steps.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    t = en * F.col("d")
    p = sum(((-1) ** (k - 1)) * F.exp(-2 * k * k * t * t) for k in range(1, 101)) * 2
    return d.select("d", F.when(t < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("p"))


def kde2d(points: DataFrame, grid: DataFrame, factor: float = 0.1, x: str = "x", y: str = "y") -> DataFrame:
    """Gaussian density at grid points (gx, gy) with the sample covariance times the factor squared. The grid is small and broadcast after a check."""
    from .match import small

    cov = points.agg(F.covar_samp(x, x).alias("sxx"), F.covar_samp(x, y).alias("sxy"), F.covar_samp(y, y).alias("syy"), F.count(F.lit(1)).alias("m"))
    f2 = factor * factor
    rows = points.select(F.col(x).alias("px"), F.col(y).alias("py")).join(small(grid.select("gx", "gy")), F.lit(True)).crossJoin(F.broadcast(cov))
    det = (F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")) * f2 * f2
    dx, dy = F.col("gx") - F.col("px"), F.col("gy") - F.col("py")
    form = (F.col("syy") * dx * dx - 2 * F.col("sxy") * dx * dy + F.col("sxx") * dy * dy) * f2 / det
    return rows.groupBy("gx", "gy").agg((F.sum(F.exp(-0.5 * form)) / (F.first("m") * 2 * math.pi * F.first(F.sqrt(det)))).alias("density"))


def shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


def reject_breakdown(df: DataFrame, reason: str = "reason", network: str = "network", station: str = "station") -> DataFrame:
    """Failures by reason, and under each by network and station; nulls stand for all."""
    return df.where(F.col(reason) != "ok").groupingSets([[reason], [reason, network], [reason, network, station]], reason, network, station).agg(F.count(F.lit(1)).alias("n"))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    out = None
    for n, (name, df) in enumerate(stages.items()):
        row = df.agg(F.lit(n).alias("step"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionAll(row)
    return out


def active_days(epochs: DataFrame, start: str, end: str) -> DataFrame:
    """Whole days for which each station has run within the period; an open end is the period's."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    secs = F.unix_seconds(F.least(F.coalesce("end_date", b), b)) - F.unix_seconds(F.greatest("start_date", a))
    return epochs.groupBy("station").agg(F.sum(F.greatest(F.lit(0), F.floor(secs / 86_400))).alias("active_days"))

