"""Byte-level BPE by monoid tree reduction.

The tokens of a byte string form a monoid under ``joined``: two encoded neighbours are joined by
re-encoding a window around the seam and widening it until the tokens beside the window stand.
They stand when each pair of neighbours at the window's edges encodes to itself: a sequence of
tokens is the encoding of its bytes if and only if all adjacent pairs are the encodings of theirs
(true for vocabularies whose merges go by rank, where every token encodes to itself). So a piece is halved down to
single bytes, which are tokens, and combined up the tree. Decoding concatenates up a tree of halves.

Texts are first cut where the splitting pattern always cuts: where white space begins. Cuts, pieces and halves
recur, so each worker keeps bounded memos of them; a memo saves work and never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .tokens import BatchEncoder, packed, portions

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of each of a worker's memos, and the bytes up to which a node of the tree is remembered.
MEMO, SHORT = 100_000, 12
#: Ids whose bytes are put together at once, the leaves of decoding.
RUN = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The tokens of a short byte string: join the neighbours of lowest rank, leftmost first, until none joins."""
    get, none = ranks.get, 1 << 60
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
    while pairs and (least := min(pairs)) < none:
        at = pairs.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], none)
    return [ranks[x] for x in parts]


class TreeCodec:
    """Encodes and decodes byte strings for one vocabulary. ``joins`` counts the joins made."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.decimals = np.array(list(map(str, range(len(self.bytes_of)))), dtype=object)
        self._fits: dict[tuple[int, int], bool] = {}
        self._nodes: dict[bytes, list[int]] = {}
        self._windows: dict[bytes, list[int]] = {}
        self.joins = 0
        self.batches = BatchEncoder(lambda cuts: [packed(self.encode_cut(c)) for c in cuts.to_pylist()])

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) > MEMO:
                self._fits.clear()
            known = self._fits[a, b] = self.window(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def window(self, data: bytes) -> list[int]:
        """The tokens of the bytes around a seam."""
        if (known := self._windows.get(data)) is None:
            if len(self._windows) >= MEMO:
                self._windows.clear()
            known = merged(self.ranks, data)
            if len(data) <= SHORT:
                self._windows[data] = known
        return known

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes."""
        if not a or not b:
            return a or b
        self.joins += 1
        fits, i, j = self.fits, 1, 1
        if fits(a[-1], b[0]):
            return a + b
        data = self.bytes_of[a[-1]] + self.bytes_of[b[0]]
        while True:
            mid = self.window(data)
            left = i == len(a) or fits(a[-i - 1], mid[0])
            right = j == len(b) or fits(mid[-1], b[j])
            if left and right:
                return a[:-i] + mid + b[j:]
            i, j = i if left else min(2 * i, len(a)), j if right else min(2 * j, len(b))
            data = self.decode(a[-i:]) + self.decode(b[:j])

    def encode_bytes(self, data: bytes) -> list[int]:
        """The tokens of one piece: a byte is a token, longer strings are their halves joined."""
        if len(data) < 2:
            return [self.ranks[data]] if data else []
        if (known := self._nodes.get(data)) is None:
            half = len(data) // 2
            known = self.joined(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if len(data) <= SHORT:
                if len(self._nodes) >= MEMO:
                    self._nodes.clear()
                self._nodes[data] = known
        return known

    def encode_cut(self, text: str) -> list[int]:
        """The tokens of a stretch of text, each match of the pattern apart."""
        pieces = [p.encode("utf-8", "replace") for p in self.pattern.findall(text)]
        return self.encode_bytes(pieces[0]) if len(pieces) == 1 else list(chain.from_iterable(map(self.encode_bytes, pieces)))

    def encode(self, text: str) -> list[int]:
        """The tokens of a text."""
        return self.batches.encode([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, halves first."""
        if len(ids) <= RUN:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(1)
def codec(path: str) -> TreeCodec:
    """One codec to a worker."""
    return TreeCodec(read_ranks(path), public_tokenizers.PATTERN)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """A row for each row of ``df``: id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids.

    Null texts count as empty: no tokens. One pass without a shuffle; repeated rows stay. ``vocabulary``: a rank file.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    small_batches(df.sparkSession)
    own = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    given = kind = dict(own.dtypes)["doc_id"]
    if given in ("tinyint", "smallint", "int", "bigint"):  # pandas would make them doubles beside a null
        own, kind = own.withColumn("doc_id", F.col("doc_id").cast("string")), "string"
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"]
            for at, end in portions(texts):
                ids, bounds = c.batches.encode(texts[at:end])
                written, rows = c.decimals[ids], []
                for i, j in pairwise(bounds.tolist()):
                    row = (j - i, hashlib.sha256(",".join(written[i:j].tolist()).encode()).hexdigest(), hashlib.sha256(c.decode(ids[i:j].tolist())).hexdigest())
                    rows.append((*row, ids[i:j].astype(np.int32)) if keep_ids else row)
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])
                out.insert(0, "doc_id", keys.iloc[at:end].to_numpy())
                yield out

    rows = own.mapInPandas(encoded, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast(given)).withColumnRenamed("doc_id", id_col)


def decode_documents(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a binary column ``decoded``: the bytes of its ids; null for null ids."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("binary")
    def decoded(column: pd.Series) -> pd.Series:
        c = codec(path)
        return column.map(lambda ids: None if ids is None else c.decode(list(ids)))

    return df.withColumn("decoded", decoded(ids_col))
