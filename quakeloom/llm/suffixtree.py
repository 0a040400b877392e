"""Language-model scores by a probabilistic suffix tree over words.

The symbols are lower-cased words and an end after each text. The root's distribution is that of words alone, smoothed so that
unknown ones share a symbol. A context of up to ``DEPTH`` words becomes a state if its next symbols differ from those of its suffix
by more than their number warrants (a likelihood ratio test); suffixes of states are states. A state's distribution is smoothed
with its suffix's. Each symbol is predicted by the longest state that its history ends in.

Texts are kept as numbers in blocks with dictionaries of their own. A string (a context and a symbol) is in the tree only if it
has a fixed share of all tokens, so strings are counted level by level, longer ones only where both shorter ones were kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard
from .vocabulary import likely_slots, numbered, places, slot, slots_for, written

#: Words of the longest context.
DEPTH = 3
#: The least share of all tokens that a string needs to be in the tree, so at most 1 / SHARE strings of a length are; and the least count.
SHARE = 1e-6
LEAST = 2
#: Tokens of a block.
BLOCK_TOKENS = 3 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b""
_SYMBOL = (1 << 32) - 1
#: The end's number, beyond those of words.
END_ID = 1 << 30


def words(text: bytes) -> list[bytes]:
    """Words of a text: ASCII letters in lower case, parted at the six ASCII blanks."""
    return text.translate(_LOWER).split()


@dataclass
class Corpus:
    """Texts in blocks of numbers, and what is known of all training tokens. ``blocks``: lists ``keys, held, sizes`` with a place for each
    document; ``codes`` of tokens; by code ``counts`` and ``ids`` (-1: not frequent). ``frequent``: ``id, c``."""

    blocks: DataFrame
    frequent: DataFrame
    tokens: int
    ends: int
    vocabulary: int
    least: float


@dataclass
class Level:
    """Strings of one length, ascending. ``keys``: the place of the string without its last symbol, shifted by 32, and the symbol.

    ``tail``: the place of the string without its first word among the shorter ones. As a context, ``state`` tells whether it is one,
    ``add`` the weight of its suffix's distribution and ``of`` the divisor.
    """

    keys: np.ndarray
    counts: np.ndarray
    tail: np.ndarray
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    add: np.ndarray = field(default_factory=lambda: np.zeros(0))
    of: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _encoder(block_tokens: int):
    """From columns key, held_out, text to rows of blocks and of their words. Code 0 is the end."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        keys, held, sizes, parts, total, kind = [], [], [], [], 0, None
        code = defaultdict()
        code.default_factory = code.__len__
        code[_END] = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number, total
            if not keys:
                return
            tokens = np.concatenate(parts)
            rank = np.argsort(np.argsort(-np.bincount(tokens), kind="stable"), kind="stable").astype(np.int32)  # common words get small codes
            train = np.bincount(tokens[np.repeat(~np.array(held), sizes)], minlength=len(code))
            k = len(code)
            null = [None] * k
            cols = [
                pa.array([number] * (k + 1), pa.int64()), pa.array([*rank.tolist(), None], pa.int32()), pa.array([*code, None], pa.binary()), pa.array([*train.tolist(), None], pa.int64()),
                pa.array([*null, keys], pa.list_(kind)), pa.array([*null, held], pa.list_(pa.bool_())), pa.array([*null, sizes], pa.list_(pa.int32())), pa.array([*null, rank[tokens].tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "code", "word", "n", "keys", "held", "sizes", "codes"])
            number, total = number + 1, 0
            for x in (keys, held, sizes, parts, code):
                x.clear()
            code[_END] = 0

        for batch in batches:
            kind = batch.column(0).type
            for key, out_of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = words(text.as_py())
                own.append(_END)
                parts.append(np.fromiter(map(code.__getitem__, own), dtype=np.int64, count=len(own)))
                keys.append(key)
                held.append(out_of)
                sizes.append(len(own))
                total += len(own)
                if total > block_tokens:
                    yield from out()
        yield from out()

    return encode


def read_corpus(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", share: float = SHARE, block_tokens: int = BLOCK_TOKENS) -> Corpus:
    """All documents as numbers, and the counts of words in those that aren't held out. Null texts are empty."""
    rows = docs.select(F.col(key), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    own = T.StructType([*T.StructType.fromDDL("block long, code int, word binary, n long").fields, T.StructField("keys", T.ArrayType(rows.schema[0].dataType)), *T.StructType.fromDDL("held array<boolean>, sizes array<int>, codes binary").fields])
    parts = written(rows.mapInArrow(_encoder(block_tokens), own), "tokens")
    units = parts.where("word is not null").select(F.col("block").alias("of"), "code", "word", "n")
    counts = written(units.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    tokens, vocabulary, ends = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.octet_length("word") == 0, F.col("c")))).first()
    least = max(LEAST, share * (tokens or 0))
    frequent = written(numbered(counts.where((F.col("c") >= least) & (F.octet_length("word") > 0)), "frequent"), "frequent")
    end_id = F.when(F.octet_length("word") == 0, F.lit(END_ID))  # the end is a symbol, but in no context
    known = counts.join(frequent.select("word", "id"), "word", "left").select("word", "c", F.coalesce("id", end_id, F.lit(-1)).cast("int").alias("id"))
    units = units.drop("n").join(known, "word").select("of", "code", "c", "id")
    blocks = parts.where("codes is not null").select("block", "keys", "held", "sizes", "codes")
    schema = T.StructType([*blocks.schema.fields[1:], *T.StructType.fromDDL("counts binary, ids binary").fields])

    def joined(block: pa.Table, units: pa.Table) -> pa.Table:
        at = units.column("code").to_numpy()
        by_code = []
        for name, kind in (("c", np.int64), ("id", np.int32)):
            values = np.zeros(len(at), dtype=kind)
            values[at] = units.column(name).to_numpy()
            by_code.append(pa.array([values.tobytes()], pa.binary()))
        return pa.table([*(block.column(n) for n in schema.names[:4]), *by_code], names=schema.names)

    whole = written(blocks.groupBy("block").cogroup(units.groupBy("of")).applyInArrow(joined, schema), "corpus")
    discard(parts, counts)
    return Corpus(whole, frequent.select("id", "c"), tokens or 0, ends or 0, vocabulary or 0, least)


class Texts:
    """A block: the numbers of its tokens one after the other, and where its documents start."""

    def __init__(self, held: list, sizes: list, codes: bytes, counts: bytes, ids: bytes):
        self.sizes = np.array(sizes, dtype=np.int64)
        self.codes = np.frombuffer(codes, np.int32)
        self.ids, self.counts = np.frombuffer(ids, np.int32)[self.codes], np.frombuffer(counts, np.int64)
        self.starts, self.train = np.cumsum(self.sizes) - self.sizes, np.repeat(~np.array(held, dtype=bool), self.sizes)
        self.inside = (np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)).astype(np.int32)

    def strings(self, levels: list[Level]) -> list[np.ndarray]:
        """For each length the place of the string that ends at a token among those kept, or -1; of length 1 the word's number."""
        out = [np.where(self.ids < END_ID, self.ids, -1)]
        for d, level in enumerate(levels, 1):
            at, keys = self.keys(out[-1], d)
            out.append(np.full(len(self.ids), -1, dtype=np.int32))
            out[-1][at] = places(level.keys, keys)
        return out

    def keys(self, shorter: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where strings of ``d`` + 1 symbols end whose contexts were kept, and their keys."""
        at = np.flatnonzero((shorter[:-1] >= 0) & (self.ids[1:] >= 0) & (self.inside[1:] >= d)) + 1
        return at, shorter[at - 1].astype(np.int64) << 32 | self.ids[at]


def _opened(batch: pa.RecordBatch) -> Iterator[Texts]:
    """The blocks of a batch, one at a time."""
    for i in range(batch.num_rows):
        held, sizes, *rest = (batch.column(k)[i] for k in range(1, 6))
        yield Texts(held.as_py(), sizes.as_py(), *(x.as_buffer() for x in rest))


def _differs(level: Level, counts: np.ndarray, of_suffix: np.ndarray, warranted: float) -> np.ndarray:
    """Which contexts of ``level``'s strings differ from their suffix: their place among the shorter strings.

    ``counts``: observations of each context; ``of_suffix``: for each string the share of its symbol after the context's suffix.
    """
    context, n = level.keys >> 32, len(counts)
    p = level.counts / counts[context]
    gain = np.bincount(context, weights=level.counts * np.log(p / of_suffix), minlength=n)
    kept, q = np.bincount(context, weights=level.counts, minlength=n), np.bincount(context, weights=of_suffix, minlength=n)
    left = counts - kept
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where((left > 0) & (q < 1 - 1e-9), left * np.log(left / counts / (1 - q)), 0.0)
    symbols = np.bincount(context, minlength=n)
    return (symbols > 0) & (gain + rest > warranted * symbols)


def train(corpus: Corpus, depth: int = DEPTH) -> tuple[np.ndarray, list[Level]]:
    """(counts of frequent words, levels). What reaches the driver are counts of strings, at most 1 / share of each length."""
    spark = corpus.blocks.sparkSession
    table = corpus.frequent.toArrow()
    single = np.zeros(table.num_rows, dtype=np.int64)
    single[table.column("id").to_numpy()] = table.column("c").to_numpy()
    levels: list[Level] = []
    for d in range(1, depth + 1):
        sent = spark.sparkContext.broadcast([(level.keys, level.tail) for level in levels])

        def keys_of(batch: pa.RecordBatch, sent=sent, d=d) -> Iterator[tuple[np.ndarray, None]]:
            own = [Level(k, k, tail) for k, tail in sent.value]
            for block in _opened(batch):
                at, keys = block.keys(block.strings(own)[-1], d)
                keys = keys[block.train[at]]
                yield (keys[places(own[-1].keys, _tail(keys, own[-1])) >= 0] if d > 1 else keys), None  # no string is more frequent than it is without its first word

        likely = None if d > 1 else spark.sparkContext.broadcast(likely_slots(corpus.blocks, keys_of, corpus.least, slots_for(corpus.tokens)))

        def strings(batches: Iterator[pa.RecordBatch], likely=likely, keys_of=keys_of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, _ in keys_of(batch):
                    if likely is not None:
                        keys = keys[likely.value[slot(keys, len(likely.value))]]
                    distinct, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.int64()), pa.array(n, pa.int64())], names=["string", "c"])

        found = corpus.blocks.mapInArrow(strings, "string long, c long").groupBy("string").agg(F.sum("c").alias("c")).where(F.col("c") >= corpus.least).toArrow()
        sent.destroy()
        keys, counts = found.column("string").to_numpy(), found.column("c").to_numpy()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        tail = (keys & _SYMBOL) if d == 1 else places(levels[-1].keys, _tail(keys, levels[-1]))
        levels.append(Level(keys, counts, tail))
    _make_states(single, levels, corpus)
    return single, levels


def _tail(keys: np.ndarray, below: Level) -> np.ndarray:
    """Keys of strings without their first words: the tail of the context, which is one of ``below``, and the symbol."""
    return below.tail[keys >> 32] << 32 | (keys & _SYMBOL)


def _make_states(single: np.ndarray, levels: list[Level], corpus: Corpus) -> None:
    """Tests all contexts, adds the suffixes of those that pass, and sets what smooths them. Context d lies in ``levels[d - 1]`` of strings."""
    warranted = math.log(max(corpus.tokens, 2))
    passed = []
    for d, level in enumerate(levels):
        counts = single if d == 0 else levels[d - 1].counts
        if d == 0:
            symbol = level.keys & _SYMBOL
            q = np.where(symbol == END_ID, corpus.ends, np.append(single, 0)[np.minimum(symbol, len(single))]) / max(1, corpus.tokens)
        else:
            below, at = levels[d - 1], level.tail
            q = below.counts[at] / (single if d == 1 else levels[d - 2].counts)[below.keys[at] >> 32]
        passed.append(_differs(level, counts, q, warranted))
    for d in range(len(levels) - 1, 0, -1):  # contexts of d + 1 words are strings of levels[d - 1]
        passed[d - 1][levels[d - 1].tail[passed[d]]] = True
    for d, level in enumerate(levels):
        counts = single if d == 0 else levels[d - 1].counts
        context, n = level.keys >> 32, len(counts)
        kept, symbols = np.bincount(context, weights=level.counts, minlength=n), np.bincount(context, minlength=n)
        level.state, level.add, level.of = passed[d], symbols + counts - kept, counts + symbols


def score(corpus: Corpus, model: tuple[np.ndarray, list[Level]], key: str = "doc_id") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each document.

    ``base_score`` is the root's. Equal texts score alike; an empty text is its end only.
    """
    spark: SparkSession = corpus.blocks.sparkSession
    sent = spark.sparkContext.broadcast(model[1])  # bounded, see train
    tokens, divisor = corpus.tokens, corpus.tokens + 0.5 * (corpus.vocabulary + 1)
    kind = T.StructField(key, corpus.blocks.schema["keys"].dataType.elementType)
    schema = T.StructType([kind, *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            for i, block in enumerate(_opened(batch)):
                base = ((block.counts + 0.5) / divisor)[block.codes]
                p = probabilities(block, base, levels)
                add = lambda v: np.add.reduceat(v, block.starts)  # noqa: E731  no document is without its end
                n = len(block.sizes)
                known = add((block.counts > 0)[block.codes].astype(np.int64))
                cols = [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(block.sizes), pa.array(known), pa.array(np.full(n, tokens)), pa.array(add(np.log10(base))), pa.array(add(np.log10(p)))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return corpus.blocks.select("keys", "held", "sizes", "codes", "counts", "ids").mapInArrow(scored, schema)


def probabilities(block: Texts, base: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Of each token after its history. States are closed under suffixes, so going from short to long ones ends at the longest."""
    strings, p = block.strings(levels), base.copy()
    for d, level in enumerate(levels, 1):
        at = np.flatnonzero((strings[d - 1][:-1] >= 0) & (block.inside[1:] >= d)) + 1
        own = strings[d - 1][at - 1]
        at, own = at[level.state[own]], own[level.state[own]]
        string = strings[d][at]
        c = np.where(string >= 0, level.counts[string], 0) if len(level.counts) else 0
        p[at] = (c + level.add[own] * p[at]) / level.of[own]
    return p
