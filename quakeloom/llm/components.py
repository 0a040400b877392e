"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v) with m, the smallest of u and its neighbours. The minimum is combined map-side, so a hub costs no more."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges.u == least.k).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge; component is the smallest node reachable.

    Works for any type that sorts. Null ends and loops are left out. Each round is
    checkpointed to the shared folder. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = e.where("u is not null and v is not null and u <> v").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        e = small.select(F.col("v").alias("u"), "m").union(small.select("u", "m")).where("u <> m").distinct()
        e = e.withColumnRenamed("m", "v").checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
