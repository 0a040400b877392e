"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of characters is an anchor if the smallest of its inner s-mers (by hash, leftmost of equals) is its first or its
last. That depends on the k-mer alone, so the same passage has the same anchors wherever it stands, and an edit
changes none beyond k characters. ``anchors`` gives them with their places, for positional matching;
``fingerprints`` sketches them: anchors are dealt by hash into ``BINS`` bins and each bin keeps its least
value. The likeness of two sketches, the share of bins that agree, estimates the share of anchors in common.

All of it is array access, hashing and aggregates over one row per character inside a stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Characters of a k-mer and of its inner s-mers; bins of a sketch; hex digits for a bin.
K, S, BINS, DIGITS = 16, 4, 64, 4


def _turned(h: Column, bits: int) -> Column:
    return h if bits == 0 else F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def _kmers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pos, hash`` of the anchors. All k-mers of a text too short to be sure of one; one anchor for fewer than k characters, none too."""
    chars = df.select(*keys, F.split(F.col(text), "").alias("c"), F.char_length(text).alias("n"))
    at = chars.select(*keys, "n", "c", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - K))).alias("pos"))
    # Each step names its columns, so nothing is computed twice.
    one = at.select(*keys, "n", "pos", *[F.xxhash64(F.get("c", F.col("pos") + i)).alias(f"h{i}") for i in range(K)])
    # An s-mer's value mixes its characters' hashes by place; xor and turns only, so nothing overflows.
    inner = [reduce(Column.bitwiseXOR, [_turned(F.col(f"h{i + j}"), 13 * j) for j in range(S)]) for i in range(K - S + 1)]
    # The last column is not deterministic in Spark's eyes, which keeps the filter above the projection.
    code = one.select(*keys, "n", "pos", *[v.alias(f"s{i}") for i, v in enumerate(inner)], F.spark_partition_id().alias("p"))
    least = F.least(*[F.col(f"s{i}") for i in range(1, K - S)])
    code = code.select(*keys, "n", "pos", "p", "s0", f"s{K - S}", least.alias("mid"), F.xxhash64(*[f"s{i}" for i in range(0, K - S + 1, S)]).alias("hash"))
    first, last = F.col("s0"), F.col(f"s{K - S}")
    edge = (first <= F.least("mid", last)) | ((last < F.col("mid")) & (last < first))
    return code.where((edge | (F.col("n") < 2 * K - S)) & (F.col("p") >= 0)).select(*keys, "pos", "hash")


def anchors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pos, hash``: a row for each anchor of each row's whole text, place in code points. Null counts as empty."""
    own = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    return _kmers(own, ["id"], "t").withColumnRenamed("id", id_col)


def sketches(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, fingerprint``: 64 bins of 4 hex digits, ``----`` for an empty one. Equal texts have equal fingerprints."""
    rows = _kmers(df, keys, text).select(*keys, F.col("hash").bitwiseAND(F.lit(BINS - 1)).alias("bin"), F.shiftrightunsigned("hash", 33).cast("int").alias("v"))
    least = rows.groupBy(*keys).agg(*[F.min(F.when(F.col("bin") == b, F.col("v"))).alias(f"b{b}") for b in range(BINS)])
    # The order of v decides the least; digits of another hash of it tell the bins' values apart.
    shown = [F.coalesce(F.lower(F.lpad(F.hex(F.xxhash64(f"b{b}").bitwiseAND(F.lit(16**DIGITS - 1))), DIGITS, "0")), F.lit("-" * DIGITS)) for b in range(BINS)]
    shown = [F.when(F.col(f"b{b}").isNull(), F.lit("-" * DIGITS)).otherwise(s) for b, s in enumerate(shown)]
    return least.select(*keys, F.concat(*shown).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """The share of bins, of those that either sketch fills, in which both agree; 1 for two empty ones."""
    piece = lambda c, i: F.substr(F.col(c), i * DIGITS + 1, F.lit(DIGITS))
    empty, bins = F.lit("-" * DIGITS), F.sequence(F.lit(0), F.lit(BINS - 1))
    either = F.size(F.filter(bins, lambda i: (piece(a, i) != empty) | (piece(b, i) != empty)))
    same = F.size(F.filter(bins, lambda i: (piece(a, i) == piece(b, i)) & (piece(a, i) != empty)))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``row`` (a unique key) and, for each of ``columns``, the value of the next row by descending id, round the end to the first.

    Ids are cut into ranges at approximate quantiles and each range is ordered apart; the first row of each
    range stands once more at the end of the range above, so no order passes through one task. Ties go by the columns.
    Rows without an id come last.
    """
    spark = df.sparkSession
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    # Counting from the top: range 0 holds the largest ids.
    below = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(id_col))) if cuts else F.lit(0)
    place = F.when(F.col(id_col).isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below)
    own = df.select(F.col(id_col).alias("id"), *columns, place.cast("int").alias("range"))
    tops = sorted(((r[0], r[1]) for r in own.groupBy("range").agg(F.max("id")).collect()), key=lambda r: r[0])  # a row for each range
    first, above = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, (r, top) in enumerate(tops):
        first[r], above[r] = top, tops[i - 1][0]
    kind = dict(own.dtypes)["id"]
    is_first = F.col("id").eqNullSafe(F.get(F.array(*[F.lit(x).cast(kind) for x in first]), F.col("range")))
    here = F.struct(F.col("range"), F.lit(0).alias("ghost"))
    again = F.struct(F.get(F.array(*[F.lit(x).cast("int") for x in above]), F.col("range")).alias("range"), F.lit(1).alias("ghost"))
    placed = own.select("id", *columns, F.explode(F.when(is_first, F.array(here, again)).otherwise(F.array(here))).alias("to"))
    placed = placed.select("id", *columns, "to.range", "to.ghost")
    by = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), *columns)
    number = F.shiftleft(F.col("range").cast("long"), 40).bitwiseOR(F.row_number().over(by).cast("long"))
    rows = placed.select("id", *columns, "range", "ghost", number.alias("row"), *[F.lead(c).over(by).alias(f"next_{c}") for c in columns], F.lead("id").over(by).alias("next_id"))
    return rows.where("ghost = 0").drop("range", "ghost")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for each distinct (id, text). Null texts count as empty."""
    own = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"), F.xxhash64(text_or_empty(text_col)).alias("x"))
    return sketches(own, ["id", "x"], "t").select(F.col("id").alias(id_col), "fingerprint")
