"""What block-wise counting of words shares: tables written once, dense numbers for words, sums by number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table of the shared folder; it cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path  # for common.discard
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with dense numbers from 0 as ``id``: places within a partition after the sizes of those before. Written, so that they stand."""
    placed = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("id", (F.col("_before") + place).cast("int")).drop("_part", "_at", "_before")


def summed(ids: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Weights added up by id, in whole numbers."""
    order = np.argsort(ids, kind="stable")
    sums = np.concatenate([[0], np.cumsum(weights[order])])
    upto = np.searchsorted(ids[order], np.arange(size + 1))
    return sums[upto[1:]] - sums[upto[:-1]]


def places(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where each sought value stands in the ascending ``keys``, or -1."""
    if not len(keys):
        return np.full(len(sought), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return np.where(keys[at] == sought, at, -1)


def slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """One of so many slots (a power of two) for each key."""
    with np.errstate(over="ignore"):
        return ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & (slots - 1)


def slots_for(tokens: int) -> int:
    """A slot for 32 tokens, so that most hold few keys; at most 2**26, which is 8 MB of bits."""
    return 1 << min(26, max(16, (tokens // 32).bit_length()))


def likely_slots(blocks: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]], least: float, slots: int) -> np.ndarray:
    """True for slots whose keys occur ``least`` times together. A key in another slot is not that frequent; none is lost.

    ``keys_of`` gives keys, and weights or None, of a batch's blocks. Counters stop at ``least``, so they are small; a task adds those of its blocks first.
    """
    most = int(np.ceil(least))
    kind = np.dtype(np.uint8 if most < 128 else np.uint32)
    span = min(slots, 1 << 16)

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype=kind)
        for batch in batches:
            for keys, weights in keys_of(batch):
                at = slot(keys, slots)
                if weights is None:
                    own, n = np.unique(at, return_counts=True)
                else:
                    own, back = np.unique(at, return_inverse=True)
                    n = summed(back.ravel(), weights, len(own))
                total[own] = np.minimum(most, n + total[own])
        parts = total.reshape(-1, span)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.zeros(span, dtype=np.int64)
        for c in parts.column("counts"):
            total += np.frombuffer(c.as_buffer(), dtype=kind)
        return pa.table({"part": parts.column("part").slice(0, 1), "bits": pa.array([np.packbits(total >= most).tobytes()], pa.binary())})

    rows = blocks.mapInArrow(counters, "part int, counts binary").groupBy("part").applyInArrow(added, "part int, bits binary").toArrow()
    found = dict(zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist(), strict=True))
    none = bytes(-(-span // 8))
    return np.concatenate([np.unpackbits(np.frombuffer(found.get(p, none), np.uint8))[:span] for p in range(slots // span)]).astype(bool)
