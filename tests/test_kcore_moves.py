"""Pruning to a fixed point moves rows once, and equals the rows' own rounds."""

import random

import pytest

from quakeloom.operators import magnitude


def measured(spark, n=600):
    rng = random.Random(4)
    rows = [(i, f"S{int(rng.paretovariate(0.8)) % 90}", rng.randrange(150), "x") for i in range(n)] + [(n, None, 3, "x"), (n + 1, "S1", None, "x")]
    rows += [(n + 2 + i, "twice", 7, "x") for i in range(9)]
    return spark.createDataFrame(rows, "arid long, station string, event_id long, more string")


def by_rule(rows, min_sta, min_ev):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    while True:
        of = lambda c: {k: sum(r[c] == k for r in rows) for k in {r[c] for r in rows}}
        s, e = of(1), of(2)
        kept = [r for r in rows if s[r[1]] >= min_sta and e[r[2]] >= min_ev]
        if len(kept) == len(rows):
            return sorted(kept)
        rows = kept


@pytest.mark.parametrize("most", [5_000_000, 3])
@pytest.mark.parametrize("least", [(8, 5), (4, 2), (1, 1), (500, 500)])
def test_equals_the_rule(spark, monkeypatch, least, most):
    monkeypatch.setattr(magnitude, "MOST_STATIONS", most)
    df = measured(spark)
    want = by_rule([tuple(r) for r in df.collect()], *least)
    assert sorted(map(tuple, magnitude.kcore_prune(df, *least).collect())) == want
    assert want or least == (500, 500)


def test_no_round_writes_the_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(magnitude, "cut", lambda df, cut=magnitude.cut: written.append(df.columns) or cut(df))
    magnitude.kcore_prune(measured(spark), 8, 5).collect()
    assert written and all("more" not in c for c in written)
    magnitude.kcore_prune(measured(spark).limit(0), 8, 5).collect()
