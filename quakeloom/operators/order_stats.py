"""Exact order statistics and running sums without a task that holds a group's values.

Quantiles: every group's sought ranks get a bracket from a mergeable sketch; what lies below it is counted, what lies inside is kept as
distinct values with their counts, and brackets are split by sixteen until few values are left. The counts are exact, so a bracket
that misses its rank is seen and widened. Running sums: values are dealt out by range, ranges are summed first, then each row within its range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Distinct values of a bracket that one task orders.
LEAF = 10_000
#: Of the sketch; brackets reach five of its steps to both sides.
ACCURACY = 10_000
SPLITS = 16


def _same(a: DataFrame, b: DataFrame, keys: list[str], prefix: str = "_k_") -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[prefix + k]) for k in keys])


def beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that has a row for each value of the keys, nulls being values."""
    if not keys:
        return rows.crossJoin(F.broadcast(table))  # one row
    other = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return rows.join(other, _same(rows, other, keys), how).drop(*[f"_k_{k}" for k in keys])


def quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] = (), name: str = "q") -> DataFrame:
    """``by, name``: an array with each quantile, linear between ranks. Nulls are left out, NaN is the largest; groups without a value give no row."""
    by, big = list(by), F.lit(float("nan"))
    small = F.lit(float("-inf"))
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    wide = [min(1.0, max(0.0, p + side * 5 / ACCURACY)) for p in probs for side in (-1, 1)]
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(p) for p in wide]), F.lit(ACCURACY)).alias("_s"))
    few = F.col("_n") <= LEAF

    def target(t: int, p: float) -> Column:
        at = F.lit(p) * (F.col("_n") - 1)
        low, high = F.when(few, small).otherwise(F.get("_s", F.lit(2 * t))), F.when(few, big).otherwise(F.get("_s", F.lit(2 * t + 1)))
        return F.struct(F.lit(t).alias("t"), at.alias("at"), low.alias("low"), high.alias("high"))

    ends = cut(ends.select(*by, "_n", F.array(*[target(t, p) for t, p in enumerate(probs)]).alias("_targets")))
    state = _inside(rows, ends, by)
    missed = _missed(state, ends, by)
    if not missed.isEmpty():
        lost = missed.select(*by, F.col("_t").alias("t")).groupBy(*by).agg(F.collect_set("t").alias("_lost"))
        again = beside(ends, lost, by).withColumn("_targets", F.transform(F.filter("_targets", lambda x: F.array_contains("_lost", x["t"])), lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), small.alias("low"), big.alias("high")))).drop("_lost")
        state = cut(beside(state, missed.select(*by, "_t").withColumn("_miss", F.lit(True)), [*by, "_t"], "left").where("_miss is null").drop("_miss").unionByName(_inside(rows, again, by)))
    before = None
    while (size := state.where("_v is not null").groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first())[0] and size[0] > LEAF:
        if size == before:
            raise RuntimeError("brackets no longer shrink")
        state, before = _split(state, by), size
    return _picked(state, by, len(probs), name)


def _inside(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """``by, _t, _at, _n, _v, _c``: counts of the values inside each bracket; a null value counts what lies below it."""
    both = beside(rows, ends, by)
    near = F.transform(F.filter("_targets", lambda x: F.col("_v") <= x["high"]), lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), F.when(F.col("_v") >= x["low"], F.col("_v")).alias("v")))
    own = both.select(*by, "_n", "_v", F.explode(near).alias("x"))
    return cut(own.groupBy(*by, F.col("x.t").alias("_t"), F.col("x.at").alias("_at"), "_n", F.col("x.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))


def _missed(state: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Targets whose ranks lie outside of what was counted, or for which nothing was."""
    sought = ends.select(*by, F.explode("_targets").alias("x")).select(*by, F.col("x.t").alias("_t"), F.col("x.at").alias("_sought"))
    s = state.groupBy(*by, "_t").agg(F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("below"), F.sum("_c").alias("upto"))
    both = beside(sought, s, [*by, "_t"], "left")
    return both.where(F.col("upto").isNull() | (F.floor("_sought") < F.col("below")) | (F.ceil("_sought") >= F.col("upto")))


def _split(state: DataFrame, by: list[str]) -> DataFrame:
    keys, inside = [*by, "_t"], state.where("_v is not null")
    cuts = inside.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)]), F.lit(1000)).alias("_s"))
    part = F.size(F.filter("_s", lambda s: s < F.col("_v")))
    parted = beside(inside, cuts, keys).withColumn("_p", part).drop("_s")
    every = parted.unionByName(state.where("_v is null").withColumn("_p", F.lit(-1)))
    sums = every.groupBy(*keys, "_at", "_n", "_p").agg(F.sum("_c").alias("_w"))
    upto = Window.partitionBy(*keys).orderBy("_p")  # no more rows than SPLITS + 1
    spans = sums.withColumn("_to", F.sum("_w").over(upto))
    keep = (F.col("_p") >= 0) & (F.col("_to") - F.col("_w") <= F.ceil("_at")) & (F.col("_to") > F.floor("_at"))
    marked = spans.withColumn("_keep", keep).withColumn("_under", (F.col("_to") <= F.floor("_at")) | (F.col("_p") < 0))
    kept = beside(parted.withColumnRenamed("_p", "_t2"), marked.where("_keep").select(*keys, F.col("_p").alias("_t2")), [*keys, "_t2"]).drop("_t2")
    below = marked.where("_under").groupBy(*keys, "_at", "_n").agg(F.sum("_w").alias("_c")).withColumn("_v", F.lit(None).cast("double"))
    return cut(kept.unionByName(below))


def _picked(state: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    keys = [*by, "_t"]
    to = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))  # no more rows than LEAF + 1
    rows = state.withColumn("_to", to).withColumn("_from", F.col("_to") - F.col("_c"))
    at = lambda r: F.max(F.when(F.col("_v").isNotNull() & (F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
    low, high = F.floor("_at"), F.ceil("_at")
    pairs = rows.groupBy(*keys, "_at").agg(at(low).alias("_a"), at(high).alias("_b"))
    q = F.when((high == low) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise((high - F.col("_at")) * F.col("_a") + (F.col("_at") - low) * F.col("_b"))
    return pairs.withColumn("_q", q).groupBy(*by).agg(F.array(*[F.max(F.when(F.col("_t") == t, F.col("_q"))) for t in range(n)]).alias(name)).where(F.get(name, F.lit(0)).isNotNull())


def with_quantiles(groups: DataFrame, df: DataFrame, column: str, probs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``groups`` with a column for each named quantile of ``df``; null where a group has no value."""
    found = quantiles(df, column, list(probs.values()), by, "_q")
    out = beside(groups, found, list(by), "left") if by else groups.join(F.broadcast(found), F.lit(True), "left")  # one row at most
    return out.select(*groups.columns, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(probs)])


def running_sums(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` with columns of running sums: ``{new: column}``, over the rows of smaller or equal ``order``, whose values must be distinct.

    Rows are dealt out by range and written; the sums of all ranges are put before those of each row's own.
    """
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.min(order).alias("_o"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, of which there are as many as shuffle partitions
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(F.broadcast(offsets), "_part")
    return rows.select(*df.columns, *[(F.col(f"_b_{n}") + F.sum(c).over(own)).alias(n) for n, c in sums.items()])


def greatest_before(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """``df`` with the greatest value of ``column`` among all rows of smaller ``order``, whose values must be distinct; null where there is none."""
    ranged = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    tops = ranged.groupBy("_part").agg(F.min(order).alias("_o"), F.max(column).alias("_top"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select("_part", F.max("_top").over(before(Window.orderBy("_o"))).alias("_above"))  # a row for each range
    own = F.max(column).over(before(Window.partitionBy("_part").orderBy(order)))
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, F.greatest(own, F.col("_above")).alias(name))
