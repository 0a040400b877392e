"""Token ids as bit-plane-shuffled binary chunks.

Format of a chunk (``payload``), all numbers little-endian unsigned 32-bit:
``b"BPS1"``, ids in the chunk, ids to a block, bits to an id, planes; the byte length of each plane;
then the planes, each compressed with zstandard. Blocks are transposed to bit planes: plane p holds bit p of
each id, eight ids to a byte, block after block, the last block padded with zeros. Planes that
are zero throughout cost a few bytes, so small ids are cheap.

A chunk is a row of a Parquet table beside its index: which documents it holds, where each starts and how
long it is. Chunks hold whole documents in ascending id order; ``part, chunk`` is the order of chunks.
Spark writes the table, so a lost executor leaves no half-written chunk and any store will do.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .tokens import BatchEncoder, packed, portions

VOCABULARY = "byte_bpe_50k.json"
MAGIC, BLOCK, CHUNK_IDS, END = b"BPS1", 8192, 1 << 18, 2
WHITE = pa.array([" ", "\n", "\t", "\r"], pa.large_string())
CHUNK_SCHEMA = "part int, chunk int, first long, n_ids long, doc_ids array<long>, starts array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK, level: int = 1) -> bytes:
    """A chunk of ids (unsigned, below 2**32)."""
    ids = np.asarray(ids, dtype="<u4")
    bits = int(ids.max(initial=0)).bit_length()
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    squeeze = zstandard.ZstdCompressor(level=level)
    planes = [squeeze.compress(np.packbits(((padded >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes()) for p in range(bits)]
    return MAGIC + struct.pack(f"<4I{bits}I", len(ids), block, bits, len(planes), *map(len, planes)) + b"".join(planes)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk; a ValueError for other bytes."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of bit planes")
    n, block, bits, planes = struct.unpack_from("<4I", payload, 4)
    sizes = struct.unpack_from(f"<{planes}I", payload, 20)
    total, at, out = -(-n // block) * block, 20 + 4 * planes, None
    out = np.zeros(total, "<u4")
    stretch = zstandard.ZstdDecompressor()
    for p, size in enumerate(sizes):
        plane = np.frombuffer(stretch.decompress(payload[at : at + size]), np.uint8)
        out |= np.unpackbits(plane, bitorder="little").astype("<u4") << np.uint32(p)
        at += size
    return out[:n]


class Library:
    """The tokenizers library on many short cuts: those that begin with white space and don't end with it are joined first.

    Where such cuts meet the library cuts in any case, so the ids of the whole are theirs in a row, and the bytes of the
    tokens tell where one ends. A task has a core, so the library's own threads are off.
    """

    def __init__(self, path: str, joined: int = 512):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own, self.joined = Tokenizer.from_file(path), joined
        self.length = np.array([len(self.own.id_to_token(i) or "") for i in range(self.own.get_vocab_size())])

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, cuts: pa.Array) -> list[bytes]:
        white = pc.is_in(pc.utf8_slice_codeunits(cuts, 0, 1), WHITE)
        joins = pc.and_not(white, pc.utf8_is_space(pc.utf8_slice_codeunits(cuts, -1))).to_numpy(zero_copy_only=False)
        apart, rest = np.nonzero(~joins)[0], np.nonzero(joins)[0]
        out: list[bytes] = [b""] * len(cuts)
        for i, ids in zip(apart.tolist(), self._encoded(cuts.take(pa.array(apart)).to_pylist()), strict=True):
            out[i] = packed(ids)
        if not len(rest):
            return out
        some = cuts.take(pa.array(rest))
        sizes = pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        data = memoryview(some.buffers()[2])  # what was taken lies in a row from 0
        edges = [0, *ends[self.joined - 1 :: self.joined].tolist()]
        edges += [int(ends[-1])] * (len(ends) % self.joined > 0)
        whole = self._encoded([str(data[a:b], "utf-8") for a, b in pairwise(edges)])
        ids = np.array(list(chain.from_iterable(whole)), dtype="<u4")
        reached = np.cumsum(self.length[ids])
        stop = np.searchsorted(reached, ends) + 1
        if not (reached[np.minimum(stop, len(reached)) - 1] == ends).all():
            raise ValueError("tokens cross a cut")
        raw, first = ids.tobytes(), 0
        for i, last in zip(rest.tolist(), (4 * stop).tolist(), strict=True):
            out[i] = raw[first:last]
            first = last
        return out


@lru_cache(1)
def encoder(path: str) -> BatchEncoder:
    return BatchEncoder(Library(path))


def write_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end: int = END) -> None:
    """Encode every text, append ``end`` to each and write the chunks in ascending id order.

    Null texts count as empty (the end id alone). Rows without an id come first. Repeated rows stay,
    next to each other. An empty table writes an empty table of chunks.
    """
    spark = df.sparkSession
    small_batches(spark, 1500)
    vocab = vocabulary or public_tokenizers.path(VOCABULARY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make numbers doubles beside a null

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        encode, held = encoder(vocab).encode, []

        def chunk() -> pd.DataFrame:
            nonlocal number, first
            keys, rows = [k for k, _ in held], [x for _, x in held]
            ids, lengths = np.concatenate(rows), np.array([len(x) for x in rows], np.int64)
            row = (part, number, first, len(ids), keys, np.cumsum(lengths) - lengths, lengths, pack(ids))
            number, first = number + 1, first + len(ids)
            held.clear()
            return pd.DataFrame([row], columns=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            texts, keys = batch["text"].tolist(), [None if k is None else int(k) for k in batch["doc_id"]]
            for at, stop in portions(texts):
                ids, bounds = encode(texts[at:stop])
                for k, i, j in zip(keys[at:stop], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    held.append((k, np.append(ids[i:j], np.uint32(end))))
                    size += j - i + 1
                    if size >= CHUNK_IDS:
                        yield chunk()
                        size = 0
        if held:
            yield chunk()

    dealt.mapInPandas(chunked, CHUNK_SCHEMA).write.parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks and their index, with ``offset``: the ids of all chunks before. Only part totals meet in one place."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    return chunks.join(F.broadcast(before), "part").withColumn("offset", F.coalesce("before", F.lit(0)) + F.col("first")).drop("before")


def read_documents(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, with ``keep_ids``, the ids, from the chunks' bytes."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for offset, keys, starts, lengths, payload in zip(batch["offset"], batch["doc_ids"], batch["starts"], batch["lengths"], batch["payload"], strict=True):
                ids = unpack(payload)
                out = pd.DataFrame({"doc_id": pd.array([None if k is None else int(k) for k in keys], "Int64"), "start": starts + offset, "n_tokens": lengths})
                spans = list(zip(starts.tolist(), (starts + lengths).tolist(), strict=True))
                out["ids_crc32"] = [zlib.crc32(ids[i:j].tobytes()) for i, j in spans]
                if keep_ids:
                    out["ids"] = [ids[i:j].astype(np.int64) for i, j in spans]
                yield out

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = read_chunks(spark, path).select("offset", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "starts", "lengths", "payload")
    return rows.mapInPandas(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)
