"""The suffix tree against one of nested dictionaries, the base scores against plain counting."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quakeloom.llm import queries, suffixtree

END = None


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [END]


class Plain:
    """All strings counted at once, states by their definition, probabilities by recursion."""

    def __init__(self, texts, depth=suffixtree.DEPTH, share=suffixtree.SHARE):
        self.depth, self.count = depth, Counter()
        for text in texts:
            t = tokens(text)
            for d in range(depth + 1):
                self.count.update(tuple(t[i : i + d + 1]) for i in range(len(t) - d))
        one = {s: c for s, c in self.count.items() if len(s) == 1}
        self.n, self.v = sum(one.values()), len(one)
        least = max(suffixtree.LEAST, share * self.n)
        self.next = defaultdict(dict)
        for s, c in self.count.items():
            if len(s) > 1 and c >= least:
                self.next[s[:-1]][s[-1]] = c
        passed = {s for s in self.next if self.differs(s)}
        self.states = {s[i:] for s in passed for i in range(len(s))}

    def differs(self, s):
        n, kept = self.count[s], self.next[s]
        share = {x: (self.count[x,] / self.n if len(s) == 1 else self.next[s[1:]][x] / self.count[s[1:]]) for x in kept}
        gain = sum(c * math.log(c / n / share[x]) for x, c in kept.items())
        left, q = n - sum(kept.values()), sum(share.values())
        if left > 0 and q < 1 - 1e-9:
            gain += left * math.log(left / n / (1 - q))
        return gain > math.log(max(self.n, 2)) * len(kept)

    def base(self, x):
        return (self.count[x,] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, state, x):
        if not state:
            return self.base(x)
        kept, n = self.next.get(state, {}), self.count[state]
        return (kept.get(x, 0) + (len(kept) + n - sum(kept.values())) * self.p(state[1:], x)) / (n + len(kept))

    def score(self, text):
        t, out = tokens(text), 0.0
        for i, x in enumerate(t):
            history = tuple(t[max(0, i - self.depth) : i])
            while history and history not in self.states:
                history = history[1:]
            out += math.log10(self.p(history, x))
        return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_query_equals_the_plain_tree(spark, data):
    texts = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    m = Plain([t for i, t in texts.items() if not held(i)])
    got = {r["doc_id"]: r for r in queries.queries()["op12_suffixtree"](spark, data).collect()}
    assert got.keys() == texts.keys() and len(m.states) > 100
    for i, text in texts.items():
        t, r = tokens(text), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(m.count[x,] > 0 for x in t), m.n)
        assert r["base_score"] == pytest.approx(sum(math.log10(m.base(x)) for x in t), rel=1e-9)
        assert r["score"] == pytest.approx(m.score(text), rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.mark.parametrize(("share", "depth"), [(1e-6, 3), (0.02, 2), (0.004, 1)])
def test_blocks_and_awkward_rows(spark, share, depth):
    """Blocks of a few tokens; null, empty and long texts, repeated and null ids, words with odd blanks, a clashing column."""
    rng = random.Random(depth)
    words = ["A", "b", "ça", "\xa0e", "f\x00g", "the", "The"]
    texts = [" ".join(rng.choice(words[: 2 + i % 6]) for _ in range(rng.randrange(40))) for i in range(60)] + [None, "", " \n", "x y z " * 800, "x y z " * 800]
    rows = [(i // 2 if i % 9 else None, t, "n", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string, codes string, n int").repartition(3)
    out = F.crc32(F.col("k").cast("string")) % 5 == 1
    corpus = suffixtree.read_corpus(df, out, key="k", share=share, block_tokens=100)
    got = suffixtree.score(corpus, suffixtree.train(corpus, depth), "k")
    m = Plain([t for k, t, *_ in rows if not held(k)], depth, share)
    want = sorted((k is None, k or 0, held(k), len(tokens(t)), m.n, round(m.score(t), 6)) for k, t, *_ in rows)
    assert sorted((r["k"] is None, r["k"] or 0, r["held_out"], r["n_tokens"], r["train_tokens"], round(r["score"], 6)) for r in got.collect()) == want


def test_next_symbols_sum_to_one():
    m = Plain(["a b a b a c", "a b a b d", "b a b a b a", "a b a b a b"] * 5, share=0.0)
    known = [x for (x,) in (s for s in m.count if len(s) == 1)]
    assert m.states
    for s in m.states:
        assert sum(m.p(s, x) for x in known) + m.p(s, "unknown") == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    corpus = suffixtree.read_corpus(none, F.lit(False))
    assert suffixtree.score(corpus, suffixtree.train(corpus)).count() == 0
    only = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    corpus = suffixtree.read_corpus(only, F.lit(True))
    rows = sorted(map(tuple, suffixtree.score(corpus, suffixtree.train(corpus)).collect()))
    assert rows == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
