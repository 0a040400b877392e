"""The joint magnitude inversion as a distributed solve.

log10A = M_i + C_sp - n_p log10(r/100) - k_p r, damped, for event i, station and phase sp; the terms of a phase sum to zero by a heavy
row. Event terms are eliminated inside each event, and the reduced system of station terms and slopes is solved by
preconditioned conjugate gradients. A step sends the vector of station terms to the tasks and adds up what each event makes of it, by term; no
matrix is ever formed. Events of very many observations are not eliminated but solved for beside the stations, so that
their rows can be dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from .match import small
from .vectors import summed

#: Observations of an event above which its rows are dealt out.
HEAVY = 50_000
#: Unknowns that are sent to every task: 40 MB.
MOST_TERMS = 5_000_000
#: Observations of a partition: each partition makes a vector of all unknowns in each step, so there are few.
PART = 4_000_000


@dataclass
class _Unknowns:
    """What the indexes of the unknowns stand for."""

    names: list  # (station, phase) of the first unknowns
    phases: list
    heavy: list  # event ids of the last unknowns
    phase_of: np.ndarray
    free: bool
    d2: float

    @property
    def size(self) -> int:
        return len(self.names) + (2 if self.free else 1) * len(self.phases) + len(self.heavy)

    def columns(self, i: np.ndarray, r: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(unknown, coefficient) of each observation, but for eliminated events; an unknown of -1 is none."""
        n, p = len(self.names), len(self.phases)
        out = [(i, np.ones(len(i))), (n + self.phase_of[i], -r)]
        if self.free:
            out.append((n + p + self.phase_of[i], -np.log10(r / 100)))
        if self.heavy:
            out.append((np.where(h >= 0, self.size - len(self.heavy) + h, -1), np.where(h >= 0, 1.0, 0.0)))
        return out


def _system(obs: DataFrame, fix_n: float | None, damp: float) -> tuple[DataFrame, _Unknowns]:
    """Events packed by the thousand into arrays of bytes, and the unknowns."""
    r = F.greatest(F.col("dist_hypo_km"), F.lit(0.001))
    y = F.col("log10A") + (F.lit(fix_n) * F.log10(r / 100) if fix_n is not None else F.lit(0.0))
    rows = obs.select("event_id", "station", "phase", "dist_hypo_km", y.alias("y"), r.alias("r")).where("event_id is not null and station is not null and phase is not null and y is not null and dist_hypo_km is not null").drop("dist_hypo_km")
    names = rows.select("station", "phase").distinct()
    if names.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} station terms")
    names = sorted(map(tuple, names.collect()))
    phases = sorted({p for _, p in names})
    spark = obs.sparkSession
    kinds = [rows.schema["station"], rows.schema["phase"], T.StructField("i", T.IntegerType())]
    index = spark.createDataFrame([(s, p, i) for i, (s, p) in enumerate(names)], T.StructType(kinds))
    many = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).collect()  # at most rows / HEAVY of them
    heavy = sorted((r["event_id"], r["n"]) for r in many)
    rows = rows.join(small(index, MOST_TERMS), ["station", "phase"])
    rows = rows.withColumn("h", F.lit(-1)).withColumn("salt", F.lit(0))
    if heavy:
        kinds = [rows.schema["event_id"], T.StructField("_h", T.IntegerType()), T.StructField("_n", T.LongType())]
        known = spark.createDataFrame([(e, h, n) for h, (e, n) in enumerate(heavy)], T.StructType(kinds))
        salt = F.pmod(F.xxhash64("station", "phase", "y", "r"), F.ceil(F.col("_n") / F.lit(HEAVY)))
        rows = rows.join(F.broadcast(known), "event_id", "left").withColumn("h", F.coalesce("_h", F.lit(-1))).withColumn("salt", F.coalesce(salt, F.lit(0)))
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART))
    lists = rows.repartition(parts, "event_id", "salt").groupBy("event_id", "h", "salt").agg(F.collect_list(F.struct("i", "y", "r")).alias("o")).drop("salt")
    arrays = [T.StructField(c, T.BinaryType()) for c in ARRAYS]
    packed = lists.mapInArrow(_pack, T.StructType([T.StructField("event_id", T.ArrayType(rows.schema["event_id"].dataType)), *arrays]))
    at = {p: k for k, p in enumerate(phases)}
    return cut(packed), _Unknowns(names, phases, [e for e, _ in heavy], np.array([at[p] for _, p in names], dtype=np.int64), fix_n is None, damp * damp)


#: Columns of packed events: observations of each event and its heavy event or -1; term, y and r of each observation.
ARRAYS = {"n": np.int32, "h": np.int32, "i": np.int32, "y": np.float64, "r": np.float64}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch of events, as the same observations are read in every step."""
    for batch in batches:
        lists, ids = batch.column("o"), batch.column("event_id")
        i, y, r = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
        values = (np.diff(lists.offsets.to_numpy()), batch.column("h").to_numpy(zero_copy_only=False), i, y, r)
        rows = [pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in zip(values, ARRAYS.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *rows], names=["event_id", *ARRAYS])


def _observations(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row of packed events (term, y, r, event in the row) of each observation; observations of each event; the heavy event or -1."""
    for at in range(batch.num_rows):
        n, h, i, y, r = (np.frombuffer(batch.column(c)[at].as_buffer(), t) for c, t in ARRAYS.items())
        yield i.astype(np.int64), y, r, np.repeat(np.arange(len(n)), n), n, h


def _summed(packed: DataFrame, size: int, make: Callable) -> np.ndarray:
    """The sum over all observations of (unknown, value) pairs; ``make`` gives them for a row of packed events."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size)
        for batch in batches:
            for observations in _observations(batch):
                for j, v in make(*observations):
                    there = j >= 0
                    total += np.bincount(j[there], weights=v[there], minlength=size)
        return total

    return summed(packed.drop("event_id"), size, partial)


def _product(packed: DataFrame, system: _Unknowns, c: np.ndarray | None) -> np.ndarray:
    """The reduced normal matrix times ``c``, without damping and gauge; for None the right side."""

    def make(i, y, r, row, n, h):
        columns = system.columns(i, r, h[row])
        t = y if c is None else sum(np.where(j >= 0, c[j], 0.0) * a for j, a in columns)
        mean = np.bincount(row, weights=t, minlength=len(n)) / (n + system.d2)
        t = t - np.where(h < 0, mean, 0.0)[row]
        return [(j, a * t) for j, a in columns]

    return _summed(packed, system.size, make)


def _diagonal(packed: DataFrame, system: _Unknowns) -> np.ndarray:
    def make(i, y, r, row, n, h):
        left = np.where(h < 0, 1 - 1 / (n + system.d2), 1.0)[row]
        return [(j, a * a * left) for j, a in system.columns(i, r, h[row])]

    return _summed(packed, system.size, make)


def _solve(packed: DataFrame, system: _Unknowns, gauge_w: float, tolerance: float, most: int, start: np.ndarray) -> np.ndarray:
    """Conjugate gradients; the preconditioner is the diagonal and the gauge, whose inverse has a closed form."""
    n, w2 = len(system.names), gauge_w * gauge_w
    own = [np.flatnonzero(system.phase_of == p) for p in range(len(system.phases))]
    d = _diagonal(packed, system) + system.d2
    d[d <= 0] = 1.0

    def gauge(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for at in own:
            out[at] = w2 * x[at].sum()
        return out

    def precondition(x: np.ndarray) -> np.ndarray:
        out = x / d
        for at in own:
            out[at] -= (w2 * out[at].sum() / (1 + w2 * (1 / d[at]).sum())) / d[at]
        return out

    c = start
    if not n:
        return c
    rest = _product(packed, system, None)
    goal = tolerance * tolerance * float(rest @ precondition(rest))
    if c.any():
        rest = rest - _product(packed, system, c) - system.d2 * c - gauge(c)
    z = precondition(rest)
    p, rz = z, float(rest @ z)
    for _ in range(most):
        if rz <= goal or rz == 0.0:
            break
        q = _product(packed, system, p) + system.d2 * p + gauge(p)
        step = rz / float(p @ q)
        c, rest = c + step * p, rest - step * q
        z = precondition(rest)
        rz, before = float(rest @ z), rz
        p = z + (rz / before) * p
    return c


def invert_magnitudes(obs: DataFrame, damp: float = 1e-3, gauge_w: float = 1000.0, fix_n: float | None = None, tolerance: float = 1e-10, max_steps: int = 2000, start: tuple[DataFrame, dict[str, float]] | None = None) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Events' magnitudes, station terms and attenuation from amplitudes by damped least squares.

    ``obs``: event_id, station, phase, dist_hypo_km, log10A; rows that lack one take no part. ``fix_n`` holds n and moves its term to
    the data. Returns ``event_id, M_rel``; ``station, phase, C, n_obs``; and the slopes by ``n|phase`` and ``k|phase``.
    """
    packed, system = _system(obs, fix_n, damp)
    before = np.zeros(system.size)
    if start is not None:  # station terms and slopes of an earlier solution
        known = {(r["station"], r["phase"]): r["C"] for r in start[0].select("station", "phase", "C").collect()}
        slopes = [start[1].get(f"{k}|{x}", 0.0) for k in ("kn" if fix_n is None else "k") for x in system.phases]
        before[: len(system.names) + len(slopes)] = [*(known.get(x, 0.0) for x in system.names), *slopes]
    c = _solve(packed, system, gauge_w, tolerance, max_steps, before)
    spark, n, p = obs.sparkSession, len(system.names), len(system.phases)
    kind = obs.schema["event_id"]

    def magnitudes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (i, y, r, row, k, h) in zip(batch.column("event_id"), _observations(batch), strict=True):
                t = y - sum(np.where(j >= 0, c[j], 0.0) * a for j, a in system.columns(i, r, h[row]))
                m = np.bincount(row, weights=t, minlength=len(k)) / (k + system.d2)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(m)], names=["event_id", "M_rel"]).filter(pa.array(h < 0))

    schema = T.StructType([kind, T.StructField("M_rel", T.DoubleType())])
    mags = packed.mapInArrow(magnitudes, schema)
    if system.heavy:
        mags = mags.unionByName(spark.createDataFrame([(e, float(v)) for e, v in zip(system.heavy, c[-len(system.heavy) :], strict=True)], schema))
    coeffs = {f"k|{x}": float(c[n + at]) for at, x in enumerate(system.phases)}
    coeffs |= {f"n|{x}": float(c[n + p + at]) if fix_n is None else fix_n for at, x in enumerate(system.phases)}
    kinds = [obs.schema["station"], obs.schema["phase"], T.StructField("C", T.DoubleType())]
    solved = spark.createDataFrame([(s, x, float(v)) for (s, x), v in zip(system.names, c[:n], strict=True)], T.StructType(kinds))
    counts = obs.where("event_id is not null and dist_hypo_km is not null and log10A is not null").groupBy("station", "phase").agg(F.count(F.lit(1)).alias("n_obs"))
    return mags, solved.join(counts, ["station", "phase"]).select("station", "phase", "C", "n_obs"), coeffs


def fit_magnitudes(obs: DataFrame, damp: float = 1e-3, gauge_w: float = 1000.0, fix_n: float | None = None, k: float = 4.0) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(residuals, station terms, slopes) of two passes: the second leaves out residuals beyond ``k`` scaled MADs of the first, if there are any."""
    from .magnitude import reject_mad, residuals

    obs = cut(obs)
    mags, terms, coeffs = invert_magnitudes(obs, damp, gauge_w, fix_n)
    first = cut(residuals(obs, mags, terms, coeffs))
    kept = cut(reject_mad(first, k).select(*obs.columns))
    if kept.count() == first.count():
        return first, terms, coeffs
    mags, terms, coeffs = invert_magnitudes(kept, damp, gauge_w, fix_n, start=(terms, coeffs))
    return residuals(kept, mags, terms, coeffs), terms, coeffs
