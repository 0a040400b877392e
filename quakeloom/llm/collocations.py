"""Phrase collocations by prefix-free parsing.

Pieces of text are cut where a window of ``WINDOW`` words has a hash that triggers; neighbouring chunks overlap in that
window. So equal stretches of text give equal chunks wherever they stand, and each distinct chunk is kept once with the
number of times it is parsed. Phrases of up to ``WINDOW + 1`` words lie whole in a chunk; each belongs to the chunk that
holds its first word before the closing window, so what two chunks share is counted once. Phrases are counted inside the
distinct chunks, weighed by their parse frequencies, in blocks with dictionaries of their own: first words, then pairs of
frequent words, then longer phrases of frequent pairs. A phrase is never more frequent than its parts, so nothing is lost.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard
from .vocabulary import likely_slots, numbered, places, slot, slots_for, summed, written

WINDOW = 4
#: One window in so many triggers.
PERIOD = 16
#: Words of a block, and distinct chunks of a task before its counts are passed on.
BLOCK_WORDS = 3 << 19
TASK_CHUNKS = 200_000
#: Pairs of a task before their sums are passed on.
TASK_PAIRS = 2_000_000
#: Bits of a word's number.
WIDTH = 31
#: Frequent pairs that are sent to every task (16 MB); beyond, each block gets its own.
MOST_PAIRS = 2_000_000
#: Lower case of A-Z; punctuation and line ends part pieces.
_TABLE = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece of a text."""
    return [w for line in text.translate(_TABLE).split(b"\n") if (w := line.split())]


def triggers(hashes: np.ndarray, period: int = PERIOD) -> np.ndarray:
    """True where the window of ``WINDOW`` words that starts there triggers; the last ``WINDOW - 1`` places never do."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(hashes), dtype=bool)
    with np.errstate(over="ignore"):
        h = sum((hashes[k : k + n] * _MIX[k] for k in range(1, WINDOW)), hashes[:n] * _MIX[0])
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    out = np.zeros(len(hashes), dtype=bool)
    out[:n] = (h >> np.uint64(32)) % np.uint64(period) == 0
    return out


class Parser:
    """Cuts texts into chunks. ``chunks[lang, closed]`` counts them; a closed chunk is its piece's last and owns its closing window, too."""

    def __init__(self, period: int = PERIOD):
        self.period, self.chunks, self.hashes = period, defaultdict(Counter), {}

    def add(self, langs: list[str], texts: list[bytes]) -> None:
        words, ends, own = [], [], []
        for lang, text in zip(langs, texts, strict=True):
            for piece in pieces(text):
                words += piece
                ends.append(len(words))
                own.append(lang)
        known = self.hashes
        if len(known) > TASK_CHUNKS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        marked = np.flatnonzero(triggers(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)), self.period)).tolist()
        at, start = 0, 0
        for lang, end in zip(own, ends, strict=True):
            first, closed, opened = start, self.chunks[lang, True], None
            while at < len(marked) and marked[at] + WINDOW <= end:
                cut = marked[at]
                if cut > first:  # a window at the very start parts nothing
                    opened = self.chunks[lang, False] if opened is None else opened
                    opened[b" ".join(words[first : cut + WINDOW])] += 1
                    first = cut
                at += 1
            while at < len(marked) and marked[at] < end:  # a window over two pieces is none
                at += 1
            closed[b" ".join(words[first:end])] += 1
            start = end

    def take(self) -> pa.RecordBatch:
        flat = [(lang, chunk, closed, n) for (lang, closed), own in self.chunks.items() for chunk, n in own.items()]
        self.chunks = defaultdict(Counter)
        cols = list(zip(*flat, strict=True)) or [(), (), (), ()]
        kinds = [pa.string(), pa.binary(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "chunk", "closed", "n"])


def parse(docs: DataFrame, text: str = "text", lang: str = "lang", period: int = PERIOD) -> DataFrame:
    """The dictionary: ``lang, chunk`` (words joined by a space), ``closed``, ``n``. Null texts are empty, a null language is ``und``."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(period)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                parser.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if sum(map(len, parser.chunks.values())) > TASK_CHUNKS:
                    yield parser.take()
        yield parser.take()

    parts = rows.mapInArrow(counted, "lang string, chunk binary, closed boolean, n long")
    return parts.groupBy("lang", "chunk", "closed").agg(F.sum("n").alias("n"))


def _cut(chunks: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Chunks as codes of a dictionary with -1 after each, and the dictionary."""
    number = defaultdict()
    number.default_factory = number.__len__
    number[b"\n"] = 0  # after each chunk; no word has a line end
    tokens = (b" \n ".join(chunks) + b" \n").split(b" ")
    codes = np.fromiter(map(number.__getitem__, tokens), dtype=np.int32, count=len(tokens)) - 1
    return codes, list(number)[1:]


def _weights(codes: np.ndarray, closed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often the phrases that start at each place of the chunks are parsed; none in what belongs to the next chunk."""
    ends = np.flatnonzero(codes < 0)
    sizes = np.diff(ends, prepend=-1)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes + 1, sizes)
    owned = sizes - 1 - np.where(closed, 0, WINDOW)
    return np.where(inside < np.repeat(owned, sizes), np.repeat(n, sizes), 0)


def _blocks(chunks: DataFrame) -> DataFrame:
    """Rows of blocks (``codes``; ``closed, times`` of their chunks) and of their words (``code, word, n``), written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = defaultdict(lambda: ([], [], [])), 0, TaskContext.get().partitionId() << 24

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, (c, last, n) in held.items():
                closed, times = np.array(last, dtype=bool), np.array(n, dtype=np.int64)
                codes, words = _cut(c)
                c.clear()
                at = np.flatnonzero(codes >= 0)
                sums = summed(codes[at], _weights(codes, closed, times)[at], len(words))
                k = len(words)
                cols = [
                    pa.array([number] * (k + 1), pa.int64()), pa.array([lang] * (k + 1), pa.string()), pa.array([*range(k), None], pa.int32()), pa.array([*words, None], pa.binary()), pa.array([*sums.tolist(), None], pa.int64()),
                    *(pa.array([None] * k + [x.tobytes()], pa.binary()) for x in (codes, closed, times)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "lang", "code", "word", "n", "codes", "closed", "times"])
                number += 1
            held.clear()

        for batch in batches:
            for lang, chunk, last, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for into, x in zip(held[lang], (chunk, last, n), strict=True):
                    into.append(x)
                size += chunk.count(b" ") + 2
                if size > BLOCK_WORDS:
                    yield from out()
                    size = 0
        yield from out()

    rows = chunks.select("lang", "chunk", "closed", "n")
    return written(rows.mapInArrow(cut, "block long, lang string, code int, word binary, n long, codes binary, closed binary, times binary"), "blocks")


def _reduced(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """A block as numbers of frequent words in runs of two and more, with -1 in place of all between."""
    none = pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "weights": pa.array([], pa.binary())})
    if not blocks.num_rows or not words.num_rows:
        return none
    codes, closed, times = (np.frombuffer(blocks.column(c)[0].as_buffer(), t) for c, t in (("codes", np.int32), ("closed", bool), ("times", np.int64)))
    of = np.full(int(codes.max()) + 2, -1, dtype=np.int32)  # its last place is for the code -1
    of[words.column("code").to_numpy()] = words.column("id").to_numpy()
    ids = of[codes]
    known = ids >= 0
    before, after = np.r_[False, known[:-1]], np.r_[known[1:], False]
    run = known & (before | after)
    stay = run | np.r_[False, run[:-1]]  # one -1 after each run
    weights = _weights(codes, closed, times)[stay]
    if not len(weights) or weights.max() < 2**31:
        weights = weights.astype(np.int32)
    return pa.table({"block": blocks.column("block"), "ids": pa.array([np.where(run, ids, -1)[stay].astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary())})


def _opened(ids: pa.Scalar, weights: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weights, places where a pair starts, pairs as numbers)."""
    ids, weights = np.frombuffer(ids.as_buffer(), np.int32), weights.as_buffer()
    weights = np.frombuffer(weights, np.int32 if weights.size == ids.nbytes else np.int64).astype(np.int64)
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return ids, weights, at, ids[at].astype(np.int64) << 32 | ids[at + 1]


def _longer(ids: pa.Scalar, weights: pa.Scalar, kept: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All phrases of 3 to ``most`` words whose pairs are all in ``kept``, length by length: rows of numbers, and their sums."""
    ids, weights, at, pairs = _opened(ids, weights)
    pair = np.full(len(ids), -1, dtype=np.int64)
    pair[at] = places(kept, pairs)
    own = pair
    for m in range(3, most + 1):
        ahead = np.full(len(ids), -1, dtype=np.int64)
        ahead[: len(ids) - (m - 2)] = pair[m - 2 :]
        starts = np.flatnonzero((own >= 0) & (ahead >= 0))
        if not len(starts):
            return
        keys, first, back = np.unique(own[starts] * len(kept) + ahead[starts], return_index=True, return_inverse=True)
        own = np.full(len(ids), -1, dtype=np.int64)
        own[starts] = back.ravel()
        sums = summed(back.ravel(), weights[starts], len(keys))
        there = starts[first][sums > 0]
        yield np.stack([ids[there + k] for k in range(m)], axis=1), sums[sums > 0]


def _hashed(phrases: np.ndarray) -> np.ndarray:
    """A number for each row of numbers."""
    h = np.zeros(len(phrases), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in phrases.T:
            h = (h ^ column.astype(np.uint64)) * _MIX[2]
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _listed(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    phrases, n = [], []
    for rows, sums in found:
        phrases += rows.tolist()
        n += sums.tolist()
    return pa.table({"ids": pa.array(phrases, pa.list_(pa.int32())), "n": pa.array(n, pa.int64())})


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        _, weights, at, pairs = _opened(batch.column(1)[i], batch.column(2)[i])
        yield pairs, weights[at]


def _pairs(likely: np.ndarray | None):
    """With ``likely`` the pairs in its slots and their sums over a task's blocks, without it all pairs and the block that holds them."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            sums = summed(back.ravel(), np.concatenate([n for _, n in held]), len(keys))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                _, weights, at, own = _opened(batch.column(1)[i], batch.column(2)[i])
                if likely is None:
                    keys = np.unique(own)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(keys), batch.column(0)[i].as_py()), pa.int64())], names=["pair", "block"])
                    continue
                there = likely.value[slot(own, len(likely.value))] & (weights[at] > 0)
                keys, back = np.unique(own[there], return_inverse=True)
                held.append((keys, summed(back.ravel(), weights[at[there]], len(keys))))
                size += len(keys)
                if size > TASK_PAIRS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return pairs


def _long_phrases(reduced: DataFrame, doubles: DataFrame, least: int, most: int, slots: int) -> DataFrame:
    """``ids, f`` of frequent phrases of 3 and more words. Few frequent pairs are sent to every task, many to the blocks that hold them."""
    spark, schema = reduced.sparkSession, "ids array<int>, n long"
    if doubles.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS:
        kept = spark.sparkContext.broadcast(np.sort(doubles.select("pair").toArrow().column("pair").to_numpy()))

        def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(batch.num_rows):
                for phrases, n in _longer(batch.column(1)[i], batch.column(2)[i], kept.value, most):
                    yield _hashed(phrases), n

        likely = spark.sparkContext.broadcast(likely_slots(reduced, keys_of, least, slots))

        def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = defaultdict(list), 0

            def out() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for parts in held.values():
                    phrases, back = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
                    yield phrases, summed(back.ravel(), np.concatenate([n for _, n in parts]), len(phrases))
                held.clear()

            for batch in batches:
                for i in range(batch.num_rows):
                    for phrases, n in _longer(batch.column(1)[i], batch.column(2)[i], kept.value, most):
                        there = likely.value[slot(_hashed(phrases), slots)]
                        held[phrases.shape[1]].append((phrases[there], n[there]))
                        size += int(there.sum())
                    if size > TASK_PAIRS:
                        yield from _listed(out()).to_batches()
                        size = 0
            yield from _listed(out()).to_batches()

        rows = reduced.mapInArrow(longer, schema)
    else:
        own = reduced.mapInArrow(_pairs(None), "pair long, block long").join(doubles.select("pair"), "pair").select(F.col("block").alias("of"), "pair")

        def within(blocks: pa.Table, own: pa.Table) -> pa.Table:
            if not blocks.num_rows or not own.num_rows:
                return _listed(iter(()))
            return _listed(_longer(blocks.column("ids")[0], blocks.column("weights")[0], np.sort(own.column("pair").to_numpy()), most))

        rows = reduced.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(within, schema)
    return rows.groupBy("ids").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _frequent_words(words: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(``of, code, id`` of each block's frequent words; ``id, lang, word, f``). Rows are moved once, by word; a word has a row a block.

    A word's number is the least place of its rows. Where places need more than ``WIDTH`` bits, words are numbered densely and joined.
    """
    same = Window.partitionBy("lang", "word")
    rows = words.withColumn("row", F.monotonically_increasing_id()).withColumn("f", F.sum("n").over(same)).withColumn("at", F.min("row").over(same))
    own = written(rows.where(F.col("f") >= least).select("of", "code", "lang", "word", "f", "at"), "frequent")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts, most = own.agg(F.max(part), F.max(place)).first()
    bits = (most or 0).bit_length()
    if (parts or 0).bit_length() + bits > WIDTH:
        singles = written(numbered(own.select("lang", "word", "f").distinct(), "numbers"), "numbers")
        return own.join(singles.drop("f"), ["lang", "word"]).select("of", "code", "id"), singles.select("id", "lang", "word", "f")
    number = F.shiftleft(part, bits).bitwiseOR(place).cast("int").alias("id")
    return own.select("of", "code", number), own.select(number, "lang", "word", "f").distinct()


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): ``lang, phrase, f`` of all phrases of 1 to ``most`` words that occur ``least`` times in their language,
    and ``lang, n``, the words of each language. Phrases are their words joined by a space. Pairs are counted only where hashed
    counters of all pairs, which are never too low, leave it open whether they are frequent.
    """
    if not 2 <= most <= WINDOW + 1:
        raise ValueError(f"phrases have 2 to {WINDOW + 1} words")
    chunks = written(parse(docs, text, lang), "chunks")
    parts = _blocks(chunks)
    discard(chunks)
    blocks, words = parts.where("codes is not null").select("block", "codes", "closed", "times"), parts.where("word is not null").select(F.col("block").alias("of"), "lang", "code", "word", "n")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
    own, singles = _frequent_words(words, least)
    reduced = written(blocks.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(_reduced, "block long, ids binary, weights binary"), "reduced")
    discard(parts)
    slots = slots_for(totals.agg(F.sum("n")).first()[0] or 0)
    likely = docs.sparkSession.sparkContext.broadcast(likely_slots(reduced, _keys, least, slots))
    doubles = written(reduced.mapInArrow(_pairs(likely), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "doubles")
    found = doubles.select(F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("ids"), "f")
    if most > 2:
        found = found.unionByName(_long_phrases(reduced, doubles, least, most, slots))
    spelled = found.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(singles.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids", "f").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    longer = spelled.select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "f")
    return singles.select("lang", F.col("word").cast("string").alias("phrase"), "f").unionByName(longer), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``most`` words by cohesion: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate has ``a >= least`` occurrences. A cut after its first k words gives score floor(1000 a n / (l r)); the lowest
    counts, ties to the smallest k. Candidates inside a longer candidate of at least ``share`` per cent of their occurrences go.
    Null and empty texts have no words, a null language is ``und``, repeated rows count as often as they stand; other columns
    are not read. An empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, text, lang, least, most)
    phrases = written(phrases, "phrases")
    words = F.split("phrase", " ")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    own = phrases.where(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = own.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left, right = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    rows = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.call_function("div", big("a") * big("n") * F.lit(1000).cast("decimal(4,0)"), big("l") * big("r")).cast("long")
    rows = rows.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    inside = own.select("lang", F.col("a").alias("longer"), "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m")).where("size(w) > 2")
    inside = inside.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inside = inside.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    rows = rows.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
