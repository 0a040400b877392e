"""Shards by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is where it
stands among its source, from 0 to 1. In the order of fractional ranks every stretch holds the sources in the
proportions of the whole, so cutting it into equal counts gives shards that match the mixture.

Ranks are counted in two steps, hash ranges or rank ranges first, so no source and no order passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _ranked(df: DataFrame, keys: list[str], bucket: str, order: list) -> DataFrame:
    """``df`` with ``rank`` from 0 within ``keys`` by (bucket, order): counts of buckets are summed, rows are ranked within a bucket."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(bucket).alias("b"), F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    rows = df.withColumn("within", within).join(offsets, (F.col(bucket) == F.col("b")) & same)
    return rows.withColumn("rank", F.col("offset") + F.col("within")).drop("within", "b", "offset", *[f"k_{k}" for k in keys])


def interleave(df: DataFrame, shards: int = 16, source_col: str = "source", id_col: str = "doc_id", seed: str = "interleave", bucket_rows: int = 4000) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: counts of shards are one apart at most, slots run from 0 without a gap.

    Every row gets a place, repeated rows too. Null sources are one source. Ties of the hash (repeated ids) go by the
    rows' other columns and do not matter beyond that. Columns of ``df`` named shard or slot are replaced.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    own = df.select(F.struct(*kept).alias("row"), F.col(source_col).cast("string").alias("src"), F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("h"))
    sizes = materialize(own.groupBy("src").agg(F.count(F.lit(1)).alias("of")), "sizes").withColumnRenamed("src", "s")
    own = own.join(sizes, own.src.eqNullSafe(sizes.s)).drop("s")
    total = sizes.agg(F.sum("of")).first()[0] or 0
    # A hash range holds about bucket_rows of its source.
    prefix = F.conv(F.substring("h", 1, 6), 16, 10).cast("long")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("of") / bucket_rows))
    ranked = _ranked(own.withColumn("range", F.floor(prefix * buckets / F.lit(1 << 24))), ["src"], "range", ["h", F.to_json("row")])
    placed = ranked.withColumn("frac", (2 * F.col("rank") + 1) / (2 * F.col("of")))
    pieces = max(1, -(-total // bucket_rows))
    placed = placed.select("row", "src", F.col("rank").alias("r"), "frac", F.floor(F.col("frac") * pieces).alias("piece"))
    ordered = _ranked(placed.withColumn("all", F.lit(0)), ["all"], "piece", ["frac", F.coalesce("src", F.lit("")), F.col("src").isNull(), "r"])
    shard = F.floor(F.col("rank") * shards / F.lit(max(total, 1)))
    first = F.ceil(F.floor(F.col("rank") * shards / F.lit(max(total, 1))) * F.lit(max(total, 1)) / shards)
    return ordered.select("row.*", shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet folders ``shard=N``, rows in the order of their slots."""
    interleave(df, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
