"""Vector codes against a plain version and DuckDB."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quakeloom.llm import queries, vec_queries, veccodes


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """(id, code, error) of whole vectors by nested loops over Python integers, and the hash of the codebooks."""
    kept = sorted(((i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(scale * x) if abs(x) < 2**52 else scale * int(x) for x in v] for _, v in kept]
    d = len(ints[0])
    cut = [[v[d * p // parts : d * (p + 1) // parts] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, own: min(range(len(books[p])), key=lambda e: (away(own, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(p, v[p]), []).append(v[p])
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(away(v[p], books[p][e]) for p, e in enumerate(c)) for v, c in zip(cut, codes, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, bytes(c).hex(), e) for (i, _), c, e in zip(kept, codes, errors, strict=True)), sha


def test_query_equals_brute_force_and_sql(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, sha = plain(rows)
    got = queries.queries()["op11_veccodes"](spark, data).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want and {r["codebooks_sha256"] for r in got} == {sha}
    label, total = {r[0]: r[2] for r in rows}, {}
    for i, _, e in want:
        total[label[i]] = total.get(label[i], 0) + e
    assert all(r["label_error"] == total[label[r["vec_id"]]] for r in got)
    duckdb.sql(f"create or replace view embeddings as select * from read_parquet('{data}/embeddings.parquet')")
    sql = duckdb.sql(vec_queries.VECCODES_SQL)
    assert sorted(sql.columns) == sorted(got[0].asDict())
    assert sorted(sql.fetchall()) == sorted(tuple(r[c] for c in sql.columns) for r in got)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, __vec int"


def awkward(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i % 7, [float(i * 7 % 5) / 3, -0.25, i / 64, 0.001 * i], None if i % 3 else 1, "own", i) for i in range(30)]
    bad = [(90, None, 1, "own", 0), (91, [1.0, None, 2.0, 3.0], 1, "own", 0), (92, [nan, 0.0, 0.0, 0.0], 1, "own", 0), (93, [0.0, -inf, 0.0, 0.0], 1, "own", 0)]
    return good, spark.createDataFrame([*good, *bad, (None, [0.5, 0.5, 0.5, 0.5], 2, "own", 0)], SCHEMA)


def test_awkward_rows(spark):
    """Bad vectors go; repeated ids, a null id, null labels, ties, and columns with the operator's names stay."""
    good, df = awkward(spark)
    rows = [(g[0], g[1]) for g in good] + [(None, [0.5] * 4)]


    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    want, sha = plain([r for r in rows if r[0] is not None], parts=2, entries=5)
    books = veccodes.learn(df.where("vec_id is not null"), "embedding", "vec_id", parts=2, entries=5)
    assert books.sha256() == sha
    out = veccodes.encode(df.repartition(5), books, "embedding", ["vec_id", "label", "__vec", "code"])
    assert out.columns == ["vec_id", "label", "__vec", "code", "error"]
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out.where("vec_id is not null").collect()) == want
    assert out.count() == 31 and out.where("code = 'own'").count() == 0
    sums = veccodes.with_label_error(out, "label").select("label", "label_error").distinct().collect()
    assert len(sums) == 3


def test_other_lengths_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [3.0, 2.0])], "vec_id long, embedding array<double>")
    books = veccodes.learn(df, "embedding", "vec_id", parts=2, entries=4)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in veccodes.encode(df, books, "embedding", ["vec_id"]).collect()}
    assert got == {1: ("0000", 0), 2: (None, None), 3: (None, None), 4: ("0100", 0)}
    none = df.limit(0)
    assert veccodes.learn(none, "embedding", "vec_id").dims == 0
    assert veccodes.encode(none, veccodes.learn(none, "embedding", "vec_id"), "embedding", ["vec_id"]).count() == 0


@pytest.mark.parametrize("size", [1.0, 3e7, 1e18, 1e37])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [size * (i * 37 % 11 - 5) / 7, size * (i % 4) + 0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, sha = plain(rows, parts=2, entries=3)
    books = veccodes.learn(df, "embedding", "vec_id", parts=2, entries=3)
    assert books.sha256() == sha
    got = veccodes.encode(df, books, "embedding", ["vec_id"]).collect()
    assert sorted((r["vec_id"], r["code"]) for r in got) == [w[:2] for w in want]
    assert all(r["error"] == (e if e < 2**63 else None) for r, (_, _, e) in zip(sorted(got, key=lambda r: r["vec_id"]), want, strict=True))


def test_decoding_gives_the_entries(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    books = veccodes.learn(df, "embedding", "vec_id")
    for r in veccodes.decode(veccodes.encode(df, books, "embedding", ["vec_id"]), books, "code", "near").limit(9).collect():
        ids = bytes.fromhex(r["code"])
        assert r["near"] == [v / 256 for p, e in enumerate(ids) for v in books.entries[p][e]]
