"""Theil-Sen's line without pairs: slopes are selected by counting inversions.

A pair's slope is at most theta where the later point does not lie above the earlier one in y - theta x. Such pairs are counted
in blocks of points: those within a block of x, those of two blocks within a bucket of y - theta x, and the rest from the numbers
of points in each block and bucket. Brackets around the sought ranks come from a bounded sample and are narrowed by counts
of all points, which are interpolated for the next tries; equal points are one with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .order_stats import quantiles

#: Points of a block.
BLOCK = 16384
#: Points whose slopes one task orders.
FEW = 4096
#: Points of the sample that gives the first brackets, and at least so many for each block, to bound buckets.
SAMPLE = 2000
EACH = 50
#: Slopes tried in each bracket at a time.
TRIES = 15
#: In brackets of no more slopes, these are too uneven to interpolate their counts.
SPARSE = 64


def _crossings(rank: np.ndarray, w: np.ndarray) -> int:
    """The weights w_i w_j of i before j with a lesser rank of j, summed. Ranks are 0 to n - 1; they are parted by one bit after the other, each part in order."""
    n, total = len(rank), 0
    rank, w, pos = rank.astype(np.int64), w.astype(np.int64), np.arange(n)
    for bit in reversed(range(max(0, n - 1).bit_length())):
        one = (rank >> bit) & 1
        start = (rank >> (bit + 1)) << (bit + 1)  # parts are full, so one begins at its least rank
        seen, ones = np.r_[0, np.cumsum(w * one)], np.r_[0, np.cumsum(one)]
        total += int(np.sum(w * (1 - one) * (seen[1:] - seen[start])))
        before = ones[:-1] - ones[start]
        to = np.where(one == 1, start + (1 << bit) + before, pos - before)
        after, weights = np.empty_like(rank), np.empty_like(w)
        after[to], weights[to] = rank, w
        rank, w = after, weights
    return total


def _ranks(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _above(x: np.ndarray, y: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """y - theta x as a rounded value and what rounding took off, so that points whose x differ in their last bits are ordered right."""
    with np.errstate(over="ignore", invalid="ignore"):
        high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)  # noqa: E731  the upper half of the bits
        p, xh, th = theta * x, high(x), high(theta)
        off = ((xh * th - p) + xh * (theta - th) + (x - xh) * th) + (x - xh) * (theta - th)
        s = y - p
        t = s - y
        rest = ((y - (s - t)) - (p + t)) - off
        z = s + rest
        low = rest - (z - s)
    sound = np.isfinite(low)
    return np.where(sound, z, s), np.where(sound, low, 0.0)


def inversions(z: np.ndarray, w: np.ndarray, group: np.ndarray | None = None) -> int:
    """The weights w_i w_j of i before j with z_j <= z_i, summed; with ``group`` (ascending) only of those in different ones."""
    rank = _ranks(np.lexsort((-np.arange(len(z)), z)))
    at = np.arange(len(z)) if group is None else np.lexsort((rank, group))  # a group in order of rank has none of its own
    return _crossings(rank[at], w[at])


def _blocks(pairs: DataFrame) -> tuple[DataFrame, int, int]:
    """Distinct points with weights in blocks of ascending (x, y), one in each partition, the number of blocks and of points."""
    points = cut(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    n = points.count()
    blocks = max(1, math.ceil(n / BLOCK))
    ranged = points.repartitionByRange(blocks, "x", "y").withColumn("b", F.spark_partition_id())
    return cut(ranged), blocks, n


def counts(points: DataFrame, blocks: int, thetas: list[float], some: pd.DataFrame) -> dict[float, int]:
    """For each theta the number of pairs with different x and a slope of at most theta. Buckets are bounded by the points of ``some``."""
    steps = (np.arange(1, blocks) / blocks) if len(some) else []
    bounds = [np.unique(np.quantile(some["y"].to_numpy() - t * some["x"].to_numpy(), steps, method="nearest")) if blocks > 1 else np.array([]) for t in thetas]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each theta's pairs of the block (q -1), and the block's points by bucket: ascending in z, those of equal z from the last x to the first."""
        d = pd.concat([pd.DataFrame({c: [] for c in ("x", "y", "w", "b")}), *batches])
        for b, g in d.groupby("b"):
            x, y, w = (g[c].to_numpy(t) for c, t in (("x", float), ("y", float), ("w", np.int64)))
            at = np.lexsort((y, x))
            x, y, w = x[at], y[at], w[at]
            back = np.lexsort((y, -x))  # points of one x have no slope: where they are level after rounding, they stay in order
            edge = (x == x[0]) | (x == x[-1])  # only these can have points in other blocks, too
            for k, theta in enumerate(thetas):
                z, low = _above(x, y, theta)
                order = back[np.lexsort((low[back], z[back]))]
                none = np.array([])
                yield pd.DataFrame({"k": [k], "q": [-1], "b": [int(b)], "z": [none], "low": [none], "x": [none], "w": [np.array([_crossings(_ranks(order), w)])]})
                if blocks > 1:
                    zs, ls, xs, es = z[order], low[order], x[order], edge[order]
                    first = np.flatnonzero(np.r_[True, (zs[1:] != zs[:-1]) | (ls[1:] != ls[:-1]) | ((xs[1:] != xs[:-1]) & (es[1:] | es[:-1]))])  # level points become one
                    zs, ls, xs, ws = zs[first], ls[first], xs[first], np.add.reduceat(w[order], first)
                    q = np.searchsorted(bounds[k], zs, side="left")
                    parts = np.flatnonzero(np.diff(q)) + 1
                    yield pd.DataFrame({"k": k, "q": q[np.r_[0, parts]], "b": int(b), **{c: np.split(v, parts) for c, v in (("z", zs), ("low", ls), ("x", xs), ("w", ws))}})

    def crossed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """Pairs of one bucket from different blocks, and to each block its points there and those of earlier ones."""
        if key[1] < 0:
            return pd.DataFrame({"k": [key[0]], "q": [-1], "b": [-1], "w": [0], "e": [0], "c": [sum(int(v[0]) for v in g["w"])]})
        g = g.sort_values("b")
        z, low, x, w = (np.concatenate(g[c].tolist()) for c in ("z", "low", "x", "w"))
        b = np.repeat(g["b"].to_numpy(), [len(v) for v in g["z"]])
        held = np.zeros(blocks, np.int64)
        np.add.at(held, b, w)
        c = np.zeros(blocks, np.int64)
        c[0] = _crossings(_ranks(np.lexsort((b, -x, low, z))), w)
        return pd.DataFrame({"k": key[0], "q": key[1], "b": np.arange(blocks), "w": held, "e": np.cumsum(held) - held, "c": c})

    rows = points.select("x", "y", "w", "b").mapInPandas(place, "k int, q int, b int, z array<double>, low array<double>, x array<double>, w array<long>")
    cells = rows.groupBy("k", "q").applyInPandas(crossed, "k int, q int, b int, w long, e long, c long")  # blocks squared: as many as points, over BLOCK
    above = F.coalesce(F.sum("e").over(Window.partitionBy("k", "b").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = cells.withColumn("a", above).groupBy("k").agg(F.sum((F.col("w").cast("decimal(18,0)") * F.col("a").cast("decimal(18,0)") + F.col("c")).cast("decimal(38,0)")).alias("c"))
    found = {r["k"]: int(r["c"]) for r in summed.collect()}
    return {v: found.get(t, 0) for t, v in enumerate(thetas)}


def select_slopes(points: DataFrame, blocks: int, n: int, ranks: list[int], total: int, rel: float = 1e-13) -> list[float]:
    """The slopes of these ranks (from 0) among the ascending slopes of all ``total`` pairs with different x of the ``n`` distinct points."""
    if n <= min(FEW, BLOCK):  # one task orders their slopes
        return _few(points, ranks)
    size = max(SAMPLE, EACH * blocks)
    rate = min(1.0, size / n)
    some = points.where(F.pmod(F.xxhash64("x", "y", F.lit(11)), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000) + 1)).select("x", "y").limit(2 * size).toPandas()
    part = some.sample(min(len(some), 2 * SAMPLE), random_state=3)
    order = np.lexsort((part["y"], part["x"]))
    sx, sy = part["x"].to_numpy()[order], part["y"].to_numpy()[order]
    i, j = np.triu_indices(len(sx), 1)
    if len(i) > 500_000:
        pick = np.random.default_rng(5).choice(len(i), 500_000, replace=False)
        i, j = i[pick], j[pick]
    with np.errstate(divide="ignore", invalid="ignore"):
        sample = (sy[j] - sy[i]) / (sx[j] - sx[i])
    sample = np.sort(sample[np.isfinite(sample)])
    least = rel * 1e-3 * float(np.quantile(np.abs(sample), 0.9)) if len(sample) else 0.0
    low, high = {r: -math.inf for r in ranks}, {r: math.inf for r in ranks}
    below, upto, held = dict.fromkeys(ranks, 0), dict.fromkeys(ranks, total), dict.fromkeys(ranks, math.inf)
    for _ in range(200):
        open_ = [r for r in dict.fromkeys(ranks) if math.isinf(low[r]) or math.isinf(high[r]) or high[r] - low[r] > max(least, rel * max(abs(low[r]), abs(high[r]))) and np.nextafter(low[r], high[r]) < high[r]]
        if not open_:
            break
        tries = set()
        for r in {(low[r], high[r]): r for r in open_}.values():  # ranks of one bracket get the same tries
            inside = upto[r] - below[r]
            tries.update(_between(low[r], high[r], (r + 0.5) / total if math.isinf(high[r] - low[r]) else (r + 0.5 - below[r]) / inside, inside, 4 * inside <= held[r], sample))
        for r in open_:
            held[r] = upto[r] - below[r]
        found = counts(points, blocks, sorted(tries), some)
        for r in ranks:
            for t, c in found.items():  # the slope of rank r is at most t if more than r are
                if c > r and t < high[r]:
                    high[r], upto[r] = t, c
                elif c <= r and t > low[r]:
                    low[r], below[r] = t, c
    return [high[r] for r in ranks]


def _few(points: DataFrame, ranks: list[int]) -> list[float]:
    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat([pd.DataFrame({"x": [], "y": [], "w": []}), *batches])
        x, y, w = (d[c].to_numpy(float) for c in ("x", "y", "w"))
        i, j = np.triu_indices(len(x), 1)
        i, j = i[x[i] != x[j]], j[x[i] != x[j]]
        s = (y[j] - y[i]) / (x[j] - x[i])
        order = np.argsort(s)
        upto = np.cumsum((w[i] * w[j])[order])
        if len(s):
            yield pd.DataFrame({"k": range(len(ranks)), "s": s[order][np.searchsorted(upto, np.array(ranks), side="right")]})

    found = {r["k"]: r["s"] for r in points.select("x", "y", "w").coalesce(1).mapInPandas(pick, "k int, s double").collect()}
    return [found[k] for k in range(len(ranks))]


def _between(low: float, high: float, share: float, inside: int, shrinks: bool, sample: np.ndarray) -> list[float]:
    """Slopes to try inside a bracket that holds ``inside`` of them, ``share`` of which lie below the sought one.

    Where the bracket is open, those of the sample around that share, and outwards. Else some evenly spaced, and as long as the bracket
    shrinks by them also some ever nearer to where even density puts the sought one.
    """
    if math.isinf(low) or math.isinf(high):
        off = np.array([0.001, 0.003, 0.01, 0.03, 0.1, 0.3])
        out = {0.0, *(np.quantile(sample, np.clip(share + np.r_[-off, 0, off], 0, 1), method="nearest").tolist() if len(sample) else ())}
        edge = float(max(abs(x) for x in (low, high, *out, 1.0) if math.isfinite(x)))
        steps = edge * 4.0 ** np.arange(1, TRIES // 2 + 1)
        out |= {*(-steps if math.isinf(low) else ()), *(steps if math.isinf(high) else ())}
    else:
        near = inside > SPARSE and shrinks
        few = TRIES // 2 if near else TRIES
        out = {low + (high - low) * k / (few + 1) for k in range(1, few + 1)}
        if near:
            off = np.geomspace(max(0.5 / math.sqrt(inside), 1e-6), 0.2, (TRIES - few) // 2)
            out |= {low + (high - low) * float(p) for p in share + np.r_[-off, off]}
    return [float(x) for x in out if low < x < high]


def theil_sen(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``slope`` (median of the slopes of all pairs with different x), ``intercept``, and the 95 % bounds ``low, high`` from Kendall's variance, ties included.

    Rows without x or y take no part. Fewer than two different x give nulls.
    """
    spark = pairs.sparkSession
    schema = "slope double, intercept double, low double, high double"
    own = pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    own = cut(own)
    points, blocks, distinct = _blocks(own)
    tie = lambda by: points.groupBy(by).agg(F.sum("w").cast("decimal(38,0)").alias("k")).agg(F.sum((F.col("k") * (F.col("k") - 1) * (2 * F.col("k") + 5)).cast("decimal(38,0)")).alias("t"), F.sum((F.col("k") * (F.col("k") - 1)).cast("decimal(38,0)")).alias("p")).first()
    n = points.agg(F.sum("w")).first()[0] or 0
    tx, ty = tie("x"), tie("y")
    nt = (n * (n - 1) - int(tx["p"] or 0)) // 2
    if nt <= 0:
        return spark.createDataFrame([(None,) * 4], schema)
    sigma = math.sqrt(max(0.0, (n * (n - 1) * (2 * n + 5) - int(tx["t"]) - int(ty["t"])) / 18))
    z = 1.959963984540054
    lower, upper = max(0, min(nt - 1, round((nt - z * sigma) / 2))), max(0, min(nt - 1, round((nt + z * sigma) / 2) - 1))
    a, b, low, high = select_slopes(points, blocks, distinct, [(nt - 1) // 2, nt // 2, lower, upper], nt)
    slope = (a + b) / 2
    both = [quantiles(own.select(F.col(c).alias("v")), "v", [0.5]).first()["q"][0] for c in ("x", "y")]
    return spark.createDataFrame([(slope, both[1] - slope * both[0], low, high)], schema)
