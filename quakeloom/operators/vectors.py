"""Vectors that tasks add up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of a vector that go as one row.
BLOCK = 65_536


def summed(df: DataFrame, size: int, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of the vectors of ``size`` numbers that ``partial`` makes of each partition. They are added up block by block, not number by number."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(partial(batches), float)
        for b, at in enumerate(range(0, size, BLOCK)):
            if total[at : at + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([total[at : at + BLOCK].tobytes()], pa.binary())], names=["b", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in t.column("v"))
        return pa.table({"b": t.column("b")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    for b, v in df.mapInArrow(blocks, "b int, v binary").groupBy("b").applyInArrow(add, "b int, v binary").collect():
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(v)
    return out
