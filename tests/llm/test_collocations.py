"""Phrases counted over prefix-free chunks against plain counting, and the query against DuckDB."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeloom.llm import collocations, phrase_queries, queries


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, most=5, top=2000, share=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in own.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in own.items():
            if longer[p] and 100 * longer[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def test_query_equals_sql_and_brute_force(spark, data):
    got = queries.queries()["op13_collocations"](spark, data)
    duckdb.sql(f"create or replace view documents as select * from read_parquet('{data}/documents.parquet')")
    sql = duckdb.sql(phrase_queries.COLLOCATIONS_SQL)
    assert sql.columns == got.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(sql.fetchall()) and rows
    assert rows == plain([tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("lang", "text").collect()], 100)


@pytest.mark.parametrize(("seed", "period", "share", "sent"), [(1, 2, 100, 2_000_000), (2, 5, 60, 0), (3, 16, 100, 3)])
def test_many_cuts_and_blocks_lose_nothing(spark, monkeypatch, seed, period, share, sent):
    """Small blocks, chunks with many cuts, ties, hot lines, null and long texts, columns that the operator names itself."""
    rng = random.Random(seed)
    words = ["A", "b", "ça", "日本", "d", "\xa0e", "f\x00g", "H"]
    line = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", "\n", ". "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None]), line(rng.randrange(0, 60))) for _ in range(60)] + [("en", "b d b d b d b d b d"), ("en", None), ("de", ""), (None, " , \n")] * 9
    rows += [("fr", "one two three four five six " * 400)]
    monkeypatch.setattr(collocations.Parser.__init__, "__defaults__", (period,))
    monkeypatch.setattr(collocations.parse, "__defaults__", ("text", "lang", period))
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 50)
    monkeypatch.setattr(collocations, "MOST_PAIRS", sent)  # with few of them blocks get their own pairs
    monkeypatch.setattr(collocations, "WIDTH", 31 if sent else 2)  # or words are numbered by a join
    df = spark.createDataFrame([(a, b, "x", 1, True) for a, b in rows], "lang string, text string, chunk string, n int, closed boolean").repartition(4)
    got = collocations.collocations(df, least=4, top=30, share=share)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, top=30, share=share)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b " * 99)], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "lang string, text string"), most=6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=60), st.integers(1, 6))
def test_chunks_are_prefix_free_and_own_each_word_once(words, period):
    """Each word is owned once; no open chunk is a prefix of another of the same piece set."""
    p = collocations.Parser(period)
    p.add(["x"], [b" ".join(words)])
    own = Counter()
    for (_, closed), chunks in p.chunks.items():
        for c, n in chunks.items():
            w = c.split(b" ")
            for x in w if closed else w[: -collocations.WINDOW]:
                own[x] += n
    assert own == Counter(words)
    opened = [c.split(b" ") for c in p.chunks["x", False]]
    assert all(a == b or a != b[: len(a)] for a in opened for b in opened)


def test_triggers_follow_content():
    h = np.arange(500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (collocations.triggers(h)[100:200] == collocations.triggers(h[100:203])[:100]).all() and 5 < collocations.triggers(h).sum() < 80
