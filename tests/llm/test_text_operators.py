"""SimHash, near duplicates, decontamination, syncmers: against brute force, with awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakeloom.llm import decontamination, neardup, queries, simhash, syncmers

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace("w50", "zz"), "b"), (4, None, None), (5, "", "a"), (6, "one", "a"), (7, LONG, "c"), (8, " \t\n", "a"),
    (9, "the cat sat", "a"), (None, BASE, "a"), (1, BASE, "a"), (11, BASE.upper(), "a"), (12, "é" * 40, "d"), (13, "Ünïcödé text with ÀÉ", "d"), (14, LONG + " tail", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, 7, "x", 3) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp long, key string, component_id int")


def fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps = {r[0]: fingerprint(r[1]) for r in rows}
    ids = sorted(fps)
    want = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r[0]: (r[1], r[2]) for r in queries.op1_simhash(spark, data).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_simhash_of_awkward_rows(spark, docs):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r[0], r[1] & (2**64 - 1)): r[2] for r in got}
    assert by[(4, 0)] == by[(5, 0)] == by[(8, 0)] == 4
    assert by[(2, fingerprint(BASE))] == by[(11, fingerprint(BASE))] == by[(None, fingerprint(BASE))] == 1
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [3, 4, 7])
def test_links_connect_what_pairs_connect(spark, radius, monkeypatch):
    import random

    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius))) for s in seeds for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    want = components(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius])
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for block in (8192, 16):  # the second deals crowded keys out as pairs of blocks
        links = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in simhash.hamming_links(df, radius, block=block).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in links)
        assert components(sorted(fps), links) == want


def jaccard(a, b, k=5):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    ids = sorted(r[0] for r in rows)
    text = dict(map(tuple, rows))
    want = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if jaccard(text[a], text[b]) >= 0.8])
    df = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r[0] for r in neardup.drop_near_duplicates(df).select("doc_id").collect()}
    assert kept == set(want.values())


def test_near_duplicates_of_awkward_rows(spark, docs):
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, 9, 12, 13, None], key=str)
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_one_fingerprint_or_one_id(spark):
    """All texts of a fingerprint are compared, and different texts of one id are documents of their own."""
    import random

    words = [f"w{i}" for i in range(150)]
    shuffled = list(words)
    random.Random(1).shuffle(shuffled)
    rows = [(1, " ".join(shuffled)), (2, " ".join(words)), (3, " ".join([*words, words[-1]])), (7, " ".join(words)), (7, "quite another text of this id"), (7, "quite another text of this id"), (8, "Quite another text OF this id")]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, gone_id int, h1 string")
    got = sorted((r[0], r[1]) for r in neardup.drop_near_duplicates(df).collect())
    assert got == [(1, rows[0][1]), (2, rows[1][1]), (7, rows[4][1])]


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_sketches_bound_what_sets_share(a, b, both):
    x, y = (np.array(sorted(v | both), np.uint64).view(np.int64) for v in (a, b))
    assert neardup.most_shared(neardup.sketch(x), neardup.sketch(y)) >= len((a | both) & (b | both))
    want = len((a | both) & (b | both)) / max(1, len(a | b | both))
    assert abs(neardup.similarity_of(neardup.packed(x), neardup.packed(y)) - (want if a | b | both else 1)) < 0.02


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = components(list(range(len(texts))), [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8])
    return {r[0] for r in neardup.drop_near_duplicates(df).select("doc_id").collect()}, set(classes.values())


def test_near_duplicates_of_a_drifting_family(spark, monkeypatch):
    """Over 48 near copies of which few are like the lowest: links that do not verify must not cost those that do."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for step in range(90):
        words[rng.randrange(len(words))] = f"n{step}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    rng.shuffle(texts)
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    monkeypatch.setattr(neardup, "FEW", 4, raising=False)
    got, want = kept_of(spark, texts)
    assert got == want


def test_near_duplicates_with_text_added_or_removed(spark):
    """No pair of similarity 0.8 or more is missed, whatever the edit is."""
    import random

    rng = random.Random(11)
    draw = lambda n: [f"v{int(rng.paretovariate(0.7))}" for _ in range(n)]
    texts = []
    for n in range(60):
        a = draw(rng.randrange(60, 600))
        part = int(len(a) * rng.uniform(0.1, 0.2))
        at = rng.randrange(len(a) - part)
        other = list(a)
        for _ in range(len(a) // 40):
            other[rng.randrange(len(a))] = "changed"
        texts += [" ".join(a), " ".join([a + draw(part), draw(part) + a, a[:at] + a[at + part :], other][n % 4])]
    got, want = kept_of(spark, texts)
    assert len(texts) - len(want) > 40 and got == want


def item_matches(doc, item):
    """The similarity of the best item-sized window; the whole of a shorter document."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    d, w = words(doc), words(item)
    n, k = len(w), min(5, len(w))
    if not n or len(d) < k:
        return 0.0
    grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    g, best = grams(w), 0.0
    if not set(g) & set(grams(d)):
        return 0.0
    for s in range(max(1, len(d) - n + 1)):
        h = grams(d[s : s + n])
        best = max(best, (h & g).total() / (h | g).total())
    return best


def test_decontamination_against_all_windows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    want = {(d[0], i[0]) for d in docs for i in items if item_matches(d[1], i[1]) >= 0.8}
    got = {(r[0], r[1]) for r in queries.op3_decontamination(spark, data).collect()}
    assert want and got == want


def test_decontamination_of_planted_and_awkward_rows(spark, docs):
    item = " ".join(f"q{i}" for i in range(40))
    other = " ".join(f"z{i}" for i in range(30))
    swapped = " ".join([f"q{i}" for i in range(20, 40)] + [f"q{i}" for i in range(20)])
    cut = " ".join(f"q{i}" for i in range(37))
    texts = [(100, "x y " + item + " z"), (101, item.replace("q39", "r")), (102, swapped), (103, "a " + item.replace("q20", "r")), (104, item.upper()), (None, item), (None, "a clean text of no id"), (None, "b " + other)]
    texts += [(105, cut), (7, item), (7, "y " + other), (7, "y " + other), (106, "qq " * 20_000 + item)]
    long = " ".join(f"u{i}" for i in range(2000))
    texts += [(107, "x " + long + " y"), (108, " ".join(long.split()[:1000]))]
    all_docs = docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    items = [(1, item, 0), (2, None, 0), (3, "", 0), (4, "the cat sat", 0), (5, long, 0), (1, item, 0), (6, other, 0)]
    frame = spark.createDataFrame(items, "item_id long, text string, k1 int")
    got = [(r[0], r[1]) for r in decontamination.contaminated(all_docs, frame).collect()]
    rows = [(r["doc_id"], r["text"]) for r in all_docs.select("doc_id", "text").collect()]
    want = {(d, i) for d, t in rows for i, x, _ in items if item_matches(t, x) >= 0.8}
    assert len(got) == len(set(got)) and set(got) == want and {(102, 1), (105, 1), (7, 1), (7, 6), (None, 1), (None, 6), (106, 1), (107, 5)} <= want
    left = decontamination.remove_contaminated(all_docs, frame)
    clean = sorted((str(d), t or "") for d, t in rows if not any(item_matches(t, x) >= 0.8 for _, x, _ in items))
    assert left.columns == all_docs.columns and sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == clean
    named = all_docs.withColumns({"hit_1": F.lit(1), "hit_2": F.lit(2), "k1": F.lit(3)})
    assert decontamination.remove_contaminated(named, frame).columns == named.columns and decontamination.remove_contaminated(named, frame).count() == len(clean)
    assert decontamination.contaminated(all_docs, frame.limit(0)).count() == 0
    assert decontamination.contaminated(all_docs.limit(0), frame).count() == 0


def test_syncmer_query(spark, data):
    rows = sorted(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op5_syncmers(spark, data).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for n, (i, text) in enumerate(rows):
        follows = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_next"] <= 1
    far = [r["near_next"] for r in got.values()]
    near = [r["near_edited"] for r in got.values()]
    assert sum(near) / len(near) > 0.2 > sum(far) / len(far)


def test_anchors_are_free_of_context_and_awkward_rows_work(spark, docs):
    whole = "The quick brown fox jumps over the lazy dog and runs far away from all of it."
    df = spark.createDataFrame([(1, whole), (2, "Prefix! " + whole), (3, whole[20:])], "doc_id long, text string")
    at = {}
    for r in syncmers.anchors(df).collect():
        at.setdefault(r[0], {})[r[1]] = r[2]
    assert {p + 8: h for p, h in at[1].items()}.items() <= at[2].items()
    assert {p - 20: h for p, h in at[1].items() if p >= 20}.items() == at[3].items()
    assert max(b - a for a, b in zip(sorted(at[1]), sorted(at[1])[1:])) <= syncmers.K - syncmers.S
    marks = {(r[0], r[1]) for r in syncmers.fingerprints(docs).collect()}
    assert {i for i, _ in marks} == {r[0] for r in ROWS}
    assert len({f for i, f in marks if i in (4, 5)}) == 1
    around = syncmers.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"]).collect()
    assert len(around) == len(ROWS) and all(r["next_text"] is not None for r in around)
    assert syncmers.with_next(docs.select("doc_id", "text").limit(0), "doc_id", ["text"]).count() == 0
