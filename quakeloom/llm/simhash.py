"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``radius // 2 + 1`` segments. Two fingerprints within
``radius`` bits have a segment that differs by one bit at most: were every segment two bits
apart, the whole would be more than ``radius`` apart. So each fingerprint is indexed by every
segment with one bit left out (64 keys), fingerprints that share a key are compared, and the
graph of the pairs within the radius gives the classes.

Equal fingerprints are one node from the start, so copies cost one row each. Within a key the
comparison gives a spanning set of links, not all pairs, once the key holds many fingerprints;
keys that hold very many are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialize, text_or_empty
from .components import connected_components

#: Fingerprints under one key of which all pairs are returned; beyond, a spanning set of links is.
FEW = 48


def word_spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's words (A-Z lower-cased, split at ASCII white space) joined by single spaces; starts and ends of the words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def shingle_hashes(text: str, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of all words where there are fewer; none for no word."""
    joined, starts, ends = word_spans(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(starts) <= k:
        return np.array([h(joined, seed)], dtype=np.uint64)
    pairs = zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((h(joined[i:j], seed) for i, j in pairs), dtype=np.uint64, count=len(starts) - k + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_column(text: str | Column, k: int = 4, distinct: bool = False) -> Column:
    """The fingerprint over k-word shingles as a signed long; null text counts as empty. ``distinct``: each shingle once."""

    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.uint64)
        for n, t in enumerate(texts):
            h = shingle_hashes(t, k)
            out[n] = majority_bits(np.unique(h) if distinct else h)
        return pd.Series(out.view(np.int64))

    return fp(text_or_empty(text))


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by a bit at most."""
    n = radius // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variant_keys(fp: Column, radius: int) -> Column:
    """64 keys: (bit left out, its segment's other bits). The left-out bit tells the segment, too."""
    out = []
    for low, width in segments(radius):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        out += [part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))).bitwiseOR(F.lit((low + i) << 40)) for i in range(width)]
    return F.array(*out)


def _first_key(x: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
    """The left-out bit of the first key that two fingerprints share, from their xor."""
    at, open_ = np.full(len(x), -1, np.int64), np.ones(len(x), bool)
    for low, width in cut:
        part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        fits = open_ & (np.bitwise_count(part) <= 1)
        bit = np.log2(np.maximum(part[fits], 1).astype(np.float64)).astype(np.int64)
        at[fits] = low + bit
        open_ &= ~fits
    return at


def _spanning(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs within the radius connect, n at most for a round; blocks bound the memory."""
    n = len(fp)
    label, out = np.arange(n), []
    step = max(1, (1 << 21) // n)
    while True:
        new = label.copy()
        for at in range(0, n, step):
            near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= radius
            who = np.where(near, label[None, :], n).argmin(1)
            rows = np.nonzero(label[who] < label[at : at + step])[0]
            out.append((rows + at, who[rows]))
            new[rows + at] = label[who[rows]]
        if (new == label).all():
            return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
        label = new


def _links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within the radius among rows (key, part, fp) sorted by key and part."""
    cut, rest = segments(radius), None

    def linked(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        start = np.nonzero(new)[0]
        size = np.diff(np.append(start, len(key)))
        row = np.arange(len(key))
        place = row - np.repeat(start, size)
        few = np.repeat(size <= FEW, size) & (part == 0)
        bit = key >> 40
        active = row[few & (place >= 1)]
        for back in range(1, FEW):
            active = active[place[active] >= back]
            if not len(active):
                break
            x = fp[active] ^ fp[active - back]
            near = np.bitwise_count(x) <= radius
            i, x = active[near], x[near]
            first = _first_key(x, cut) == bit[i]  # a pair that shares several keys is given once
            if first.any():
                yield pd.DataFrame({"a": fp[i[first]].view(np.int64), "b": fp[i[first] - back].view(np.int64)})
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            if n > FEW or part[s] and n > 1:
                own = fp[s : s + n]
                i, j = _spanning(own, radius)
                yield pd.DataFrame({"a": own[i].view(np.int64), "b": own[j].view(np.int64)})

    for batch in batches:
        rest = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        key, part = rest["key"].to_numpy(), rest["part"].to_numpy()
        if not len(key):
            continue
        last = int(np.nonzero((key != key[-1]) | (part != part[-1]))[0].max(initial=-1)) + 1
        if last:
            yield from linked(key[:last], part[:last], rest["fp"].to_numpy()[:last].view(np.uint64))
            rest = rest.iloc[last:]
    if rest is not None and len(rest):
        yield from linked(rest["key"].to_numpy(), rest["part"].to_numpy(), rest["fp"].to_numpy().view(np.uint64))


def hamming_links(fps: DataFrame, radius: int = 4, fp: str = "fp", block: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever pairs within ``radius`` bits connect.

    ``fps``: distinct non-null fingerprints (long). A key with over ``block`` rows is cut into blocks by
    hash; each pair of blocks is a group of its own, so no group and no task grows with the key.
    """
    keys = fps.select(F.col(fp).alias("fp")).withColumn("key", F.explode(variant_keys(F.col("fp"), radius)))
    n = fps.count()
    share = 16 if n > 16 * block else 1  # keys with many rows show in a sixteenth of them; a key missed is only slower
    heavy = None
    if n > block:
        some = keys.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(share)) == 0).groupBy("key").agg((F.count(F.lit(1)) * share).alias("n"))
        heavy = materialize(some.where(F.col("n") > block).select("key", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("blocks")), "heavy")
    if heavy is None or heavy.isEmpty():
        rows = keys.withColumn("part", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: 1 + F.least(own, j) * F.col("blocks") + F.greatest(own, j))
        rows = keys.join(heavy, "key", "left").withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs))).select("fp", "key", "part")
    return (
        rows.select("key", "part", "fp").repartition("key", "part").sortWithinPartitions("key", "part", "fp")
        .mapInPandas(lambda it: _links(it, radius), "a long, b long")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id``: a row for each row of ``docs``; classes linked by fingerprints within ``radius``.

    Null and empty texts have fingerprint zero and link like others. Repeated rows are rows of one class. A row
    without an id gets its class's smallest id, null if the class has none. Empty tables give empty results.
    """
    fps = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, k).alias("fp")), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comp = connected_components(hamming_links(nodes, radius))
    labelled = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(by_fp, fps.fp == by_fp.f).select(F.col("id").alias(id_col), "fp", "component_id")
