"""URL filters, shards, toxicity, BPE, chat, personal data, id files and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeloom.llm import bpe, chat, idfile, pii, queries, sharding, tokens, toxicity, urlfilter
from quakeloom.llm.common import new_path

AWKWARD = [(1, None), (2, ""), (3, "  \n\t x\x00y  z\xa0 w "), (4, "a" * 5000 + " b" * 200), (4, "a" * 5000 + " b" * 200), (None, "héllo wörld"), (6, "日本語 text 123's\r\n"), (7, "<|endoftext|> x")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "s", 5, "p") for i, t in AWKWARD], "doc_id long, text string, source string, ids int, part string")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_equals_library(spark, data, library):
    texts = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    for r in queries.op7_bpe(spark, data).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_awkward_rows(spark, awkward, library):
    got = bpe.encode_documents(awkward).collect()
    assert sorted((r["ids"] for r in got)) == sorted(library.encode_ordinary(t or "") for _, t in AWKWARD)
    back = bpe.decode_documents(bpe.encode_documents(awkward)).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in AWKWARD)
    assert bpe.encode_documents(awkward.limit(0)).count() == 0


def test_bpe_goes_through_the_tree(spark, data):
    """Every piece is joined up from single bytes: joins are many even where pieces recur."""
    c = bpe.TreeCodec(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), public_tokenizers.PATTERN)
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    ids, bounds = c.batches.encode(texts)
    assert c.joins > 5000
    assert all(c.decode(ids[i:j].tolist()) == t.encode() for t, i, j in zip(texts, bounds[:-1], bounds[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "éa", " ", "  ", "\n", "a", "'s", "12", "日", "-", "xq"]), max_size=120), st.integers(0, 300))
def test_joining_encodings_is_a_monoid(parts, cut):
    c = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    data = "".join(parts).replace(" ", "_").encode()
    cut = min(cut, len(data))
    whole = bpe.merged(c.ranks, data)
    assert c.joined(bpe.merged(c.ranks, data[:cut]), bpe.merged(c.ranks, data[cut:])) == whole
    assert c.encode_bytes(data) == whole
    assert "".join(tokens.chunks("".join(parts))) == "".join(parts)


def test_id_file_equals_library(spark, data, awkward):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(idfile.VOCABULARY))
    start = 0
    got = {r["doc_id"]: r for r in queries.op10_idfile(spark, data).collect()}
    for i, text in sorted(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())):
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = new_path(spark, "awkward")
    idfile.write_ids(awkward, path)
    rows = idfile.read_documents(spark, path, keep_ids=True).collect()
    assert sorted(r["ids"] for r in rows) == sorted([*own.encode(t or "", add_special_tokens=False).ids, 2] for _, t in AWKWARD)
    assert sorted(r["start"] for r in rows) == np.cumsum([0] + [r["n_tokens"] for r in sorted(rows, key=lambda r: r["start"])])[:-1].tolist()
    empty = new_path(spark, "empty")
    idfile.write_ids(awkward.limit(0), empty)
    assert idfile.read_documents(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=300), st.sampled_from([8, 64, 8192]))
def test_bit_planes_round_trip(ids, block):
    assert idfile.unpack(idfile.pack(np.array(ids, np.uint64), block)).tolist() == ids
    with pytest.raises(ValueError):
        idfile.unpack(b"none of it" + bytes(20))


def test_shards_match_the_mixture(spark, data, awkward):
    rows = queries.op4_sharding(spark, data).collect()
    source = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source").collect()))
    text = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sorted(shards) == list(range(16)) and {len(s) for s in shards.values()} <= {len(rows) // 16, -(-len(rows) // 16)}
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
        for name in set(source.values()):
            want = len(s) * list(source.values()).count(name) / len(source)
            assert abs(sum(source[r["doc_id"]] == name for r in s) - want) < 2.5
    got = sharding.interleave(awkward, 3)
    assert got.count() == len(AWKWARD) and set(awkward.columns) < set(got.columns)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [2, 3, 3]
    small = sharding.interleave(awkward, 3, bucket_rows=2)  # many ranges give the same places
    assert sorted(map(str, small.collect())) == sorted(map(str, got.collect()))
    assert sharding.interleave(awkward.limit(0), 3).count() == 0


def judged(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlfilter.RULES:
        name, prefix = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls(spark, data):
    pages = dict(map(tuple, spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()))
    rows = queries.op2_urlfilter(spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, best = judged(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]) and r["verdict"] in ("allow", "block")
        assert best is None or r["verdict"] == best[1]


def plain_verdicts(pages, bad):
    """(template, share) of each page's path by a plain walk of the tree; ``bad``: page -> 0 or 1."""
    paths = {}
    for page, url in pages:
        host, path, _ = judged(url)
        row = paths.setdefault((host, tuple(s for s in path.split("/") if s)), [0, 0, 0])
        row[0] += 1
        if page in bad:
            row[1] += 1
            row[2] += bad[page]
    out, open_ = {}, {}
    for key, row in paths.items():
        open_.setdefault((key[0], ()), []).append((key, 0, row))
    while open_:
        after = {}
        for (host, node), rows in open_.items():
            c = 0
            while all(len(k[1]) > at + c for k, at, _ in rows) and len({k[1][at + c] for k, at, _ in rows}) == 1:
                node, c = (*node, ("=", rows[0][0][1][rows[0][1] + c])), c + 1
            kids = {}
            for k, at, row in rows:
                if len(k[1]) == at + c:
                    out[k] = (host, node)
                else:
                    kids.setdefault(k[1][at + c], []).append((k, at + c + 1, row))
            sums = {seg: np.sum([r for _, _, r in own], axis=0) for seg, own in kids.items()}
            total = np.sum(list(sums.values()), axis=0) if sums else None
            rare = {seg for seg, v in sums.items() if v[0] <= max(1, urlfilter.RARE * total[0])}
            many = len(rare) > max(1, urlfilter.VARIES * sum(sums[s][0] for s in rare))
            for seg, own in kids.items():
                v, rest = sums[seg], total - sums[seg]
                pooled = (total[2] + 1) / (total[1] + 2)
                z = (v[2] / max(v[1], 1) - rest[2] / max(rest[1], 1)) / (pooled * (1 - pooled) * (1 / max(v[1], 1) + 1 / max(rest[1], 1))) ** 0.5
                branch = ("*",) if seg in rare and many else ("=", seg) if v[1] and rest[1] and abs(z) > urlfilter.Z else ("~",)
                after.setdefault((host, (*node, branch)), []).extend(own)
        open_ = after
    by, hosts = {}, {}
    for k, row in paths.items():
        by[out[k]] = np.array(by.get(out[k], (0, 0))) + row[1:]
        hosts[k[0]] = np.array(hosts.get(k[0], (0, 0))) + row[1:]
    rate = (sum(v[1] for v in hosts.values()) + 1) / (sum(v[0] for v in hosts.values()) + 4)
    share = {t: (v[1] + urlfilter.PRIOR * (hosts[t[0]][1] + urlfilter.PRIOR * rate) / (hosts[t[0]][0] + urlfilter.PRIOR)) / (v[0] + urlfilter.PRIOR) for t, v in by.items()}
    return {k: ("".join("/" + x[-1] for x in out[k][1]), share[out[k]]) for k in paths}


def test_method_verdicts_equal_a_plain_walk(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect()]
    hot = [(10_000 + i, f"http://hot.example/{'spam' if i % 3 == 0 else 'good'}/{i % 7}/x/y/{'q' if i % 5 else 'z'}/{i}") for i in range(300)]
    pages += hot + [(20_000, "http://deep.example/" + "a/" * 3000), (20_001, "http://deep.example/" + "a/" * 2000 + "b")]
    pages += [(30_000 + i, f"http://marks.example/{('~', '*', '=a', 'a')[i % 4]}/{('~', '*', 'b')[i % 3]}/{i % 9}") for i in range(240)]
    bad = {i: int(i % 3 == 0 if i >= 10_000 else i % 2) for i, _ in pages if i % 4 == 0 or i >= 30_000}
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = urlfilter.judge(frame, spark.createDataFrame(list(bad.items()), "page_id long, bad int")).collect()
    want = plain_verdicts(pages, bad)
    assert len(got) == len(pages)
    for r in got:
        template, share = want[(r["host"], tuple(s for s in r["path"].split("/") if s))]
        assert r["template"] == template and abs(r["bad_share"] - share) < 1e-9
        assert r["rule"] is not None or r["verdict"] == ("block" if share >= urlfilter.REJECT else "allow")


@pytest.mark.parametrize("name", ["spam", "~", "*", "=", "=~"])
def test_marks_in_urls_are_segments(spark, name):
    """A bad branch is rejected whatever its segment is called."""
    urls = [(i, f"http://h.example/{name}/{i}") for i in range(60)] + [(100 + i, f"http://h.example/{'abcd'[i % 4]}/{i}") for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in urls], "page_id long, bad int")
    got = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"), labels).collect()
    assert {r["verdict"] for r in got if r["page_id"] < 100} == {"block"} and {r["verdict"] for r in got if r["page_id"] >= 100} == {"allow"}


def test_large_ids_stay_beside_null_ones(spark):
    large = 9007199254740993
    df = spark.createDataFrame([(large, "a b"), (None, "c"), (-large, "")], "doc_id long, text string")
    for part in (df.coalesce(1), df):
        got = bpe.encode_documents(part)
        assert got.schema["doc_id"].dataType.simpleString() == "bigint" and {r["doc_id"] for r in got.collect()} == {large, None, -large}
        path = new_path(spark, "large")
        idfile.write_ids(part, path)
        assert {r["doc_id"] for r in idfile.read_documents(spark, path).collect()} == {large, None, -large}


def test_templates_are_rejected_by_purity(spark):
    urls = [(i, f"http://A.example/{'spam' if i % 2 else 'good'}/{i}.html") for i in range(400)]
    urls += [(5000 + i, f"http://d.example/a/b/c/d/{'spam' if i % 2 else 'good'}/{i}") for i in range(400)]  # parts at the fifth segment
    urls += [(6000 + i, f"http://e.example/{i}" if i % 4 else "http://e.example/about") for i in range(200)]  # a stable one beside many that vary
    odd = [(1000, None), (1001, "no scheme"), (1002, "x://H?q"), (1003, "http://h#f"), (1003, "http://h#f"), (None, "http://A.example/spam/5"), (1005, "http://a.example/spam/" + "z" * 9000)]
    pages = spark.createDataFrame([(i, u, "bad", 1) for i, u in urls + odd], "page_id long, url string, host string, path int")
    bad = [(i, i % 2) for i in range(0, 400, 5)] + [(5000 + i, i % 2) for i in range(0, 400, 5)] + [(6000 + i, int(i % 4 > 0 and i < 100)) for i in range(200)] + [(None, 1), (7, None)]
    labels = spark.createDataFrame(bad, "page_id long, bad int")
    got = {(r[0], r[1]): r for r in urlfilter.judge(pages, labels).collect()}
    assert len(got) == 1006
    assert all(got[(i, "a.example")]["verdict"] == ("block" if i % 2 else "allow") for i in range(400))
    assert all(got[(5000 + i, "d.example")]["verdict"] == ("block" if i % 2 else "allow") for i in range(400))
    assert all(got[(6000 + i, "e.example")]["template"] == ("/*" if i % 4 else "/about") for i in range(200))
    assert got[(1005, "a.example")]["verdict"] == "block" and got[(1000, "")]["verdict"] == "allow" and got[(1002, "h")]["path"] == ""
    assert urlfilter.judge(pages.limit(0), labels).count() == 0
    assert urlfilter.judge(pages, labels.limit(0)).where("verdict = 'block'").count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r[0]: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = dict(map(tuple, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    held = [(r["predicted"], labels[i]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_toxicity_tolerates_inserted_characters(spark, awkward):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "re", "su", "ne"]) for _ in range(rng.randint(1, 4)))
    clean = lambda: [word() for _ in range(30)]
    docs, labels = [], []
    for i in range(300):
        labels.append(i % 3 == 0)
        docs.append([set(clean()), set(clean()) | ({"grobnik", "vexpot"} if i % 3 == 0 else set())])
    model = toxicity.fit(docs, list(map(int, labels)))
    p = lambda text: model.probability(np.array([max(model.words(sorted(toxicity.words_of(text))), default=model.floor)]))[0]
    assert p("talo g r o b n i k mire") > 0.5 > p("talomire sunere")
    assert p("grobxnik") > p("talomire") and p("vexpot!") > 0.5 and p("g.r.o.b.n.i.k") > 0.5 and p("gro-bnik") > p("talo-mire")
    got = toxicity.score_documents(awkward, model)
    assert got.count() == len(AWKWARD) and got.where("score is null").count() == 0
    assert toxicity.fit([], []).probability(np.zeros(1))[0] < 0.5 and toxicity.fit([[{"a"}]], [1]).words(["b"]).shape == (1,)
    none = toxicity.train(awkward, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert toxicity.score_documents(awkward.limit(0), none).count() == 0


def test_folded_weights_equal_the_kernel():
    """The trained machine's linear form over subsequences is the Nystroem kernel machine over its landmarks."""

    def kernel(a, b):
        def counts(w):
            code, out = toxicity._code([w])[0], {}
            for i, j, k in toxicity._subsequences(len(code)):
                key = (code[i], code[j], code[k])
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return {t: v / toxicity._norm(len(code)) for t, v in out.items()}

        x, y = counts(a), counts(b)
        return sum(v * y.get(t, 0) for t, v in x.items())

    words, marks = ["grobnik", "gro-nik", "talo", "x", "vexpotvex"], ["grobnik", "vexpot", "talomi", "resune"]
    index = {t: n for n, t in enumerate(sorted(set().union(*map(toxicity._triples, marks))))}
    got = toxicity._features(words, index) @ toxicity._features(marks, index).T
    want = np.array([[kernel(a, b) for b in marks] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    w = np.random.default_rng(3).normal(size=len(marks))
    weight = np.zeros(toxicity.CODES**3, np.float32)
    weight[list(index)] = toxicity._features(marks, index).T @ w
    assert np.allclose(toxicity.Model(weight, 0.25, 1.0, 0.0, 0.0).words(words), want @ w + 0.25, atol=1e-4)
    assert toxicity.sentences_of("Not so. A b\nC") == [{"not", "so"}, {"a", "b"}, {"c"}]


def plain_base(text):
    out = []
    for kind in pii.KINDS:
        out += [(kind, m.start(), m.end()) for m in pii.BASE[kind].finditer(text) if pii.passes(kind, m[0])]
    return sorted(out, key=lambda v: (v[1], pii.KINDS.index(v[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "@", ".", "1", "12", "255", "256", "1.2.3.4", " ", "-", "+", "+1 (375) 555-4393", "4111 1111 1111 1111", "x", "é", "\n", "(", "@x.y", "a.b@c-d.e.f"]), max_size=25))
def test_base_spans_equal_the_formats(parts):
    text = "".join(parts)
    assert pii.find_spans(text, pii.Model(None, 1.1))[0] == plain_base(text)


def test_pii_query_and_awkward_rows(spark, data, awkward):
    texts = dict(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    shown = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for r in queries.op9_pii(spark, data).collect():
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert set(filter(None, shown(base).split(","))) <= set(r["spans"].split(","))
    model = pii.train(awkward)
    assert model.trees is None and pii.redact(awkward, model).columns == awkward.columns
    assert pii.annotate(awkward.limit(0), model).count() == 0
    assert pii.redacted("mail a@b.co now", [("email", 5, 11)]) == "mail [EMAIL] now"
    assert pii.find_spans("1" * 60_000 + " " + "a" * 60_000 + "@", model) == ([], [])


def test_looser_forms_are_found(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(400):
        texts.append(rng.choice([f"please write to {name()}@{name()}.org today", f"call my phone +1 ({digits(3)}) {digits(3)}-{digits(4)} now", f"the host address 10.{rng.randint(0, 255)}.1.7 is down", f"version {digits(1)}.{digits(1)}.{digits(2)} of 20{digits(2)}-0{digits(1)}-1{digits(1)} costs {digits(3)}-{digits(4)}", f"rows {digits(3)} {digits(4)} {digits(3)} and {digits(3)}.{digits(3)}.{digits(3)} in total"]))
    model = pii.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = lambda t: [k for k, _, _ in pii.find_spans(t, model)[1]]
    assert kinds("please write to anna (at) example (dot) org today") == ["email"]
    assert kinds("call my phone (017) 555-7713 now") == ["phone"]
    assert kinds("the host address 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is down") == ["ip"]
    assert kinds("rows 12 and 13 in 2014 of all") == [] and sum(map(len, map(kinds, texts[:200]))) >= 100
    assert pii.LOOSE["card"][0].search("4111,1111,1111,1111") is None


def test_boosted_trees_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = pii.Trees().fit(x[:2000], y[:2000]).probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    assert pii.calibrated(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 0, 1]), 0.9) == 0.8


def maximal(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is None, v[1] or 0, v[2] or "", v[3] or "")):
        if c is not None:
            convs.setdefault(c, []).append((r or "", x or ""))
    kept = {}
    for c in sorted(convs):
        own = convs[c]
        if any(len(o) > len(own) and o[: len(own)] == own for o in convs.values()) or own in [convs[k] for k in kept]:
            continue
        kept[c] = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in own)
    return kept


def test_chat(spark, data):
    rows = list(map(tuple, spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    assert {r["conv_id"]: r["rendered"] for r in queries.op8_chat(spark, data).collect()} == maximal(rows)
    odd = [(1, 0, "u", "a"), (1, 1, "x", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "x", "b"), (4, 0, None, None), (4, None, "u", "z"), (None, 0, "u", "q"), (5, 0, "u", "a"), (5, 0, "u", "a"), (6, 0, "", "")]
    turns = spark.createDataFrame([(*r, 9, "k") for r in odd], "conv_id long, turn long, role string, text string, pos int, conv string")
    got = {r["conv_id"]: r["rendered"] for r in chat.render(turns, chat.maximal_conversations(turns)).collect()}
    assert got == maximal(odd) and set(got) == {1, 4, 5}
    assert chat.maximal_conversations(turns.limit(0)).count() == 0
