"""Vector code compression: product codes in whole numbers, with a dictionary of values for each dimension.

A vector's components become floor(scale * x) and are cut into equal consecutive parts; a part's code is its nearest codebook
entry. In every Arrow batch each dimension has a dictionary of its distinct integers. The squared differences of all its
values to all entries are tabulated once, so a part's distances are rows gathered by dictionary codes and added. All
arithmetic is on integers, so the result does not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Below this, squared differences and their sums over a part fit in 64 bits; beyond it Python's integers are used.
SAFE = 1 << 24


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: the entries of part ``p`` as tuples of integers. ``dims``: length of the vectors (0: none was kept)."""

    dims: int
    scale: int
    entries: tuple

    def bounds(self) -> list[int]:
        parts = len(self.entries)
        return [self.dims * p // parts for p in range(parts + 1)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def usable(vec: str):
    """True for vectors without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vec).isNotNull() & ~F.exists(vec, bad)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly; as Python integers where 64 bits could be too few."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size == 0 or np.abs(scaled).max() < 2**52:
        return scaled.astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)
    return np.array([exact(float(x)) for x in values.ravel()], dtype=object).reshape(values.shape)


class Dictionaries:
    """A batch of vectors as dictionary codes: ``values[d]`` the distinct integers of dimension d, ``codes[d]`` one of them for each row."""

    def __init__(self, ints: np.ndarray):
        self.n = len(ints)
        both = [np.unique(ints[:, d], return_inverse=True) for d in range(ints.shape[1])]
        self.values, self.codes = [v for v, _ in both], [c.ravel() for _, c in both]

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part (ties to the lower) and the squared distances summed over parts."""
        bounds, found, error = books.bounds(), [], None
        for p, part in enumerate(books.entries):
            entries, away = np.array(part, dtype=object), None
            for at, d in enumerate(range(bounds[p], bounds[p + 1])):
                values, own = self.values[d], entries[:, at]
                if max(abs(values[0]), abs(values[-1]), *map(abs, own)) < SAFE:
                    values, own = values.astype(np.int64), own.astype(np.int64)
                else:
                    values = values.astype(object)
                table = (values[:, None] - own[None, :]) ** 2
                away = table[self.codes[d]] if away is None else away + table[self.codes[d]]
            if away is None:  # more parts than dimensions
                away = np.zeros((self.n, len(part)), dtype=np.int64)
            code = np.argmin(away, axis=1)
            best = away[np.arange(self.n), code]
            found.append(code)
            error = best if error is None else error + best
        return np.stack(found, axis=1), error

    def sums(self, books: Codebooks, codes: np.ndarray) -> Iterator[tuple[int, int, list, int]]:
        """(part, entry, sum of its parts, their number) of this batch, by counting dictionary codes."""
        bounds = books.bounds()
        for p, part in enumerate(books.entries):
            k = len(part)
            number = np.bincount(codes[:, p], minlength=k)
            total = []
            for d in range(bounds[p], bounds[p + 1]):
                size = len(self.values[d])
                times = np.bincount(codes[:, p] * size + self.codes[d], minlength=k * size).reshape(k, size)
                total.append(times.astype(object) @ self.values[d].astype(object) if size else np.zeros(k, dtype=object))
            for e in np.flatnonzero(number):
                yield p, int(e), [int(t[e]) for t in total], int(number[e])


def _dictionaries(vectors: pa.Array, books: Codebooks) -> Dictionaries:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return Dictionaries(whole_numbers(flat.reshape(len(vectors), books.dims), books.scale))


def learn(df: DataFrame, vec: str, key: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks from all usable vectors of ``df``.

    They start as the parts of the ``entries`` smallest keys (nulls last, equal keys by their vectors). A round assigns every
    part and replaces each entry by the floored mean of its parts; unused entries stay. What reaches the driver is
    the codebook's size: ``entries`` vectors at first, then one sum for each part, entry and dimension. All vectors of the
    length of the first one take part; others, and empty vectors, do not. An empty table gives empty codebooks.
    """
    kept = df.where(usable(vec) & (F.size(vec) > 0)).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    order = [F.col("key").asc_nulls_last(), F.col("vec")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks(0, scale, ((),) * parts)
    dims = len(first[0]["vec"])
    kept = kept.where(F.size("vec") == dims)
    start = whole_numbers(np.array([r["vec"] for r in kept.orderBy(*order).limit(entries).collect()], dtype=np.float64), scale)
    bounds = [dims * p // parts for p in range(parts + 1)]
    books = Codebooks(dims, scale, tuple(tuple(tuple(int(x) for x in v[bounds[p] : bounds[p + 1]]) for v in start) for p in range(parts)))
    for _ in range(rounds):
        books = _moved(kept.select("vec"), books)
    return books


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each task sums its own parts by entry, Spark adds the tasks' sums."""

    def sums(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in rows:
            own = _dictionaries(batch.column(0), books)
            for p, e, s, n in own.sums(books, own.assign(books)[0]):
                before = total.get((p, e))
                total[p, e] = ([a + b for a, b in zip(before[0], s, strict=True)], before[1] + n) if before else (s, n)
        flat = [(p, e, at, v, n) for (p, e), (s, n) in total.items() for at, v in enumerate(s or [0])]
        # Sums beyond 38 digits are passed in limbs of 10**18; all but the highest are not negative.
        cols = [[], [], [], [], [], []]
        for p, e, at, v, n in flat:
            limb = 0
            while True:
                v, low = (v // 10**18, v % 10**18) if abs(v) >= 10**18 else (0, v)
                for c, x in zip(cols, (p, e, at, limb, Decimal(low), n if limb == 0 else 0), strict=True):
                    c.append(x)
                limb += 1
                if v == 0:
                    break
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(20, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "entry", "at", "limb", "s", "n"])

    parted = vectors.mapInArrow(sums, "part int, entry int, at int, limb int, s decimal(20,0), n long")
    entries = [[list(e) for e in part] for part in books.entries]
    whole: dict = {}
    for r in parted.groupBy("part", "entry", "at", "limb").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        s, n = whole.get((r["part"], r["entry"], r["at"]), (0, 0))
        whole[r["part"], r["entry"], r["at"]] = (s + int(r["s"]) * 10 ** (18 * r["limb"]), n + r["n"])
    for (p, e, at), (s, n) in whole.items():
        if at < len(entries[p][e]):
            entries[p][e][at] = s // n
    return Codebooks(books.dims, books.scale, tuple(tuple(tuple(e) for e in part) for part in entries))


def encode(df: DataFrame, books: Codebooks, vec: str, keep: list[str], code: str = "code", error: str = "error") -> DataFrame:
    """The columns ``keep`` of all usable vectors, with ``code`` (two hex digits a part) and ``error`` (squared distance).

    Rows whose vector is null or holds null or non-finite components go; vectors of another length than the codebooks' get a
    null code and error, as do errors beyond 64 bits a null error. Columns of ``keep`` named like the new ones are replaced.
    """
    keep = [c for c in keep if c not in (code, error)]
    new = [T.StructField(code, T.StringType()), T.StructField(error, T.LongType())]
    if any(len(part) > 256 for part in books.entries):
        raise ValueError("two hex digits name at most 256 entries")
    fits = F.size(vec) == books.dims if books.dims else F.lit(False)
    schema = T.StructType([*df.select(*keep).schema.fields, *new])
    rows = df.where(usable(vec)).select(F.when(fits, F.col(vec)), *keep)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            digits, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if len(there):
                found, away = _dictionaries(vectors.drop_null(), books).assign(books)
                for i, row, x in zip(there.tolist(), found.astype(np.uint8), away.tolist(), strict=True):
                    digits[i], errors[i] = row.tobytes().hex(), x if x < 2**63 else None
            cols = [*batch.columns[1:], pa.array(digits, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, code, error])

    return rows.mapInArrow(codes, schema)


def decode(df: DataFrame, books: Codebooks, code: str, out: str) -> DataFrame:
    """``df`` with ``out``: the integers that a code stands for, divided by the scale; null for a null code."""
    parts = F.array(*[F.array(*[F.array(*[F.lit(v / books.scale) for v in e]) for e in part]) for part in books.entries])
    at = lambda p: F.conv(F.substring(F.col(code), F.lit(2) * p + 1, F.lit(2)), 16, 10).cast("int")
    picked = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.get(F.get(parts, p), at(p)))
    return df.withColumn(out, F.when(F.col(code).isNotNull(), F.flatten(picked)))


def with_label_error(coded: DataFrame, label: str, error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` with the error summed over equal labels (nulls together). Sums are made before rows meet, so a common label costs one row a task."""
    total = coded.groupBy(F.col(label).alias("__label")).agg(F.sum(error).alias(out))
    return coded.drop(out).join(total, coded[label].eqNullSafe(total["__label"])).drop(total["__label"])
