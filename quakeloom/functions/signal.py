"""Traces as array columns: windows, stacking, triggers, peaks; filters and scorers as Arrow batches.

A trace is a row with ``samples`` (array), ``fs`` and ``t0`` (s). What arrays can express is a column expression; filters,
resampling, response removal and scorers are ``mapInPandas`` over batches of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def assemble(traces: DataFrame, keys: list[str], alias: dict[str, str] | None = None, replicate_vertical: bool = False) -> DataFrame:
    """``z, e, n`` arrays for each key; 1 and 2 become E and N; a missing component is zeros, or the vertical."""
    comp = F.col("component")
    for a, b in (alias or {"1": "E", "2": "N"}).items():
        comp = F.when(comp == a, b).otherwise(comp)
    rows = traces.withColumn("component", comp).groupBy(*keys).pivot("component", ["Z", "E", "N"]).agg(F.first("samples"))
    some = F.coalesce("Z", "E", "N")
    zeros = F.transform(some, lambda x: x * 0)
    z = F.coalesce("Z", zeros)
    return rows.select(*keys, z.alias("z"), *[F.coalesce(c, z if replicate_vertical else zeros).alias(c.lower()) for c in ("E", "N")])


def aligned(samples: str, t0: str, fs: str, start: Column, end: Column) -> Column:
    """The part of a trace from ``start`` up to ``end``."""
    first = F.greatest(F.lit(0), F.round((start - F.col(t0)) * F.col(fs)).cast("int"))
    count = F.greatest(F.lit(0), F.round((end - start) * F.col(fs)).cast("int"))
    return F.slice(samples, first + 1, count)


def align_components(traces: DataFrame, keys: list[str]) -> DataFrame:
    """All components of a key over the interval they share."""
    w = Window.partitionBy(*keys)
    end = F.col("t0") + F.array_size("samples") / F.col("fs")
    rows = traces.withColumn("_a", F.max("t0").over(w)).withColumn("_z", F.min(end).over(w))
    return rows.withColumn("samples", aligned("samples", "t0", "fs", F.col("_a"), F.col("_z"))).withColumn("t0", F.col("_a")).drop("_a", "_z")


def is_dead(samples: str, least: float = 1e-8) -> Column:
    """Whether the mean of differences, which telescopes, is about zero."""
    n = F.array_size(samples)
    return F.when(n < 2, F.lit(True)).otherwise(F.abs((F.element_at(samples, -1) - F.element_at(samples, 1)) / (n - 1)) <= least)


def windows(traces: DataFrame, n: int = 6000, step: int = 3000, keep: list[str] = ()) -> DataFrame:
    """``win, start, samples`` of each whole window of a trace; none for a shorter trace."""
    size = F.array_size("samples")
    ok = traces.where(size >= n)
    rows = ok.select(*keep, "samples", F.explode(F.sequence(F.lit(0), F.floor((size - n) / step).cast("int"))).alias("win"))
    return rows.select(*keep, "win", (F.col("win") * step).alias("start"), F.slice("samples", F.col("win") * step + 1, F.lit(n)).alias("samples"))


def normalized(samples: str, by: str = "max", taper: int = 6, scale: Column | None = None) -> Column:
    """Demeaned samples over their greatest size, or over their deviation with a small number added; edges tapered by a cosine from 0 to 1.

    ``scale``: the deviation over all components (``joint_deviation``), where there are several. A trace of one value gives zeros.
    """
    n = F.array_size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.transform(samples, lambda x: x - mean)
    if by == "std":
        scale = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x) / n) if scale is None else scale
    else:
        scale = F.array_max(F.transform(centred, F.abs))
    ramp = lambda i: 0.5 * (1 - F.cos(F.lit(np.pi) * i / (taper - 1)))
    edge = lambda i: F.when(i < taper, ramp(i)).when(i >= n - taper, ramp(n - 1 - i)).otherwise(1.0)
    extra = EPS if by == "std" else 0.0
    return F.transform(centred, lambda x, i: (F.when(scale > 0, x / scale).otherwise(0.0) + extra) * edge(i))


def joint_deviation(*components: str) -> Column:
    """The population deviation of the demeaned samples of several components together."""
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) - F.pow(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), F.lit(2)) / F.array_size(c)
    return F.sqrt(sum(map(squares, components)) / sum(map(F.array_size, components)))


def fixed_length(samples: str, n: int) -> Column:
    """Cut or zero-padded at the end."""
    return F.concat(F.slice(samples, 1, n), F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(0), F.lit(n) - F.array_size(samples))))


def around(samples: str, t0: str, fs: str, pick: Column, before: float, after: float) -> Column:
    first = F.greatest(F.lit(0), F.floor((pick - before - F.col(t0)) * F.col(fs)).cast("int"))
    return F.slice(samples, first + 1, F.floor(F.lit(before + after) * F.col(fs)).cast("int"))


def peak(samples: str | Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def rms(samples: str | Column) -> Column:
    col = F.col(samples) if isinstance(samples, str) else samples
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x) / F.array_size(col))


def quantile98(samples: str | Column) -> Column:
    """The 98 % quantile of sizes, linear between ranks."""
    a = F.array_sort(F.transform(samples, F.abs))
    at = 0.98 * (F.array_size(a) - 1)
    low, high = F.get(a, F.floor(at).cast("int")), F.get(a, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def snr_db(signal: str | Column, noise: str | Column) -> Column:
    s, n = quantile98(signal), quantile98(noise)
    return F.when((s > 0) & (n > 0), 20 * F.log10(s / n))


#: Seconds of noise before the first pick. By case: seconds from the pick named first to the signal's start and end. Fixed values.
NOISE_S, SIGNAL_S = 8.0, {"PS": ("S", -1.0, 2.0), "P": ("P", 1.0, 4.0), "S": ("S", 0.0, 3.0)}


def phase_windows(picks: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the windows that its picks allow: ``case`` (PS, P or S), ``noise_start, noise_end, signal_start, signal_end`` in seconds.

    ``picks``: the keys, phase, time_s; of several picks of a phase the earliest counts. Noise ends at the first pick. Without a pick there is no row.
    """
    at = lambda phase: F.min(F.when(F.col("phase") == phase, F.col("time_s")))
    rows = picks.groupBy(*keys).agg(at("P").alias("P"), at("S").alias("S")).where("P is not null or S is not null")
    rows = rows.withColumn("case", F.when(F.col("S").isNull(), "P").when(F.col("P").isNull(), "S").otherwise("PS"))
    pick = lambda k: F.coalesce(*[F.when(F.col("case") == c, F.col(v[0]) + v[k]) for c, v in SIGNAL_S.items()])
    first = F.coalesce("P", "S")
    return rows.select(*keys, "case", (first - NOISE_S).alias("noise_start"), first.alias("noise_end"), pick(1).alias("signal_start"), pick(2).alias("signal_end"))


def cut_windows(traces: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, case, snr_db`` of traces (keys, t0, fs, samples) whose noise and signal windows lie inside them."""
    both = traces.join(windows, keys)
    place = lambda c: F.round((F.col(c) - F.col("t0")) * F.col("fs")).cast("int")
    inside = (F.col("noise_start") >= F.col("t0")) & (place("signal_end") <= F.array_size("samples"))
    part = lambda a, b: F.slice("samples", place(a) + 1, place(b) - place(a))
    return both.where(inside).select(*keys, "case", snr_db(part("signal_start", "signal_end"), part("noise_start", "noise_end")).alias("snr_db"))


def extremes(samples: str, fs: str) -> Column:
    top, low = F.array_max(samples), F.array_min(samples)
    return F.struct(top.alias("max_amp"), low.alias("min_amp"), ((F.array_position(F.col(samples), low) - F.array_position(F.col(samples), top)) / F.col(fs)).alias("seconds"))


def component_peaks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest peak of a key's components, and their mean."""
    return rows.withColumn("_p", peak("samples")).groupBy(*keys).agg(F.max("_p").alias("peak"), F.avg("_p").alias("mean_peak"), F.count("_p").alias("n_comp"))


#: Velocities (km/s) for the time between P and S. Fixed values.
VP, VS = 6.0, 3.5


def measure_window(dist_km: Column, phase: Column) -> Column:
    """(pre, post) seconds around a pick: post grows with distance, for P it ends short of the S arrival."""
    gap = F.greatest(dist_km * (1 / VS - 1 / VP), F.lit(1.25))
    p = F.greatest(F.least(1.0 + 0.03 * dist_km, F.lit(15.0), 0.8 * gap), F.lit(1.0))
    post = F.when(phase == "P", p).otherwise(F.least(2.0 + 0.06 * dist_km, F.lit(60.0)))
    return F.struct(F.lit(0.3).alias("pre"), post.alias("post"))


def overlap_stack(win: DataFrame, keys: list[str], blind: tuple[int, int] = (500, 500)) -> DataFrame:
    """``sample, p``: the greatest window value at each sample, the ends of windows left out. ``win``: keys, start, p (array)."""
    n = F.array_size("p")
    rows = win.select(*keys, "start", n.alias("_n"), F.posexplode("p").alias("i", "v")).where((F.col("i") >= blind[0]) & (F.col("i") < F.col("_n") - blind[1]) & ~F.isnan("v"))
    return rows.groupBy(*keys, (F.col("start") + F.col("i")).alias("sample")).agg(F.max("v").alias("p"))


def trigger(series: DataFrame, keys: list[str], thr: float = 0.05, mute: int = 300) -> DataFrame:
    """Islands of samples at or above the threshold: onset, offset, sample of the greatest value (the first of equals) and that value."""
    on = series.where((F.col("sample") >= mute) & (F.col("p") >= thr))
    by = Window.partitionBy(*keys).orderBy("sample")
    islands = on.withColumn("_g", F.col("sample") - F.row_number().over(by))
    return islands.groupBy(*keys, "_g").agg(F.min("sample").alias("onset"), F.max("sample").alias("offset"), F.max_by("sample", F.struct("p", -F.col("sample"))).alias("pick"), F.max("p").alias("max_prob")).drop("_g")


def ensemble(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest score of several models at each sample."""
    return scores.groupBy(*keys, "sample").agg(F.max("p").alias("p"))


def score_windows(win: DataFrame, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], keys: list[str]) -> DataFrame:
    """Windows with ``p`` from ``scorer()``, which is built once for each batch stream; it maps (rows, samples) to (rows, samples)."""
    kinds = dict(win.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "win", "start"]) + ", p array<double>"

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = scorer()
        for b in batches:
            if len(b):
                out = b[[*keys, "win", "start"]].copy()
                out["p"] = list(f(np.stack([np.asarray(s, float) for s in b["samples"]])))
                yield out

    return win.mapInPandas(scored, schema)


def sta_lta(short: int = 20, long: int = 200) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer: the ratio of short and long running means of energy, squeezed to 0..1."""

    def score(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.pad(x**2, ((0, 0), (1, 0))), axis=1)
        mean = lambda n: np.pad((total[:, n:] - total[:, :-n]) / n, ((0, 0), (n - 1, 0)))
        ratio = mean(short) / (mean(long) + EPS)
        ratio[:, : long - 1] = 0
        return ratio / (1 + ratio)

    return score


def _map_samples(df: DataFrame, f: Callable[[np.ndarray, float], tuple[np.ndarray, float]]) -> DataFrame:
    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [f(np.asarray(s, float), float(r)) for s, r in zip(b["samples"], b["fs"], strict=True)]
            yield b.assign(samples=[d[0] for d in done], fs=[d[1] for d in done])

    kinds = [(c, "array<double>" if c == "samples" else "double" if c == "fs" else t) for c, t in df.dtypes]
    return df.mapInPandas(mapped, ", ".join(f"`{c}` {t}" for c, t in kinds))


def bandpass(df: DataFrame, low: float | None, high: float | None, taper: float = 0.05) -> DataFrame:
    """Demeaned, tapered at both ends, and kept between the frequencies by a smooth mask of the spectrum."""

    def f(x: np.ndarray, fs: float) -> tuple[np.ndarray, float]:
        if not len(x):
            return x, fs
        n = int(len(x) * taper)
        x = x - x.mean()
        if n:
            ramp = 0.5 * (1 - np.cos(np.pi * np.arange(n) / n))
            x[:n] *= ramp
            x[-n:] *= ramp[::-1]
        freq = np.fft.rfftfreq(len(x), 1 / fs)
        mask = np.ones(len(freq))
        if low:
            mask /= np.sqrt(1 + (low / np.maximum(freq, 1e-12)) ** 8)
        if high:
            mask /= np.sqrt(1 + (freq / high) ** 8)
        return np.fft.irfft(np.fft.rfft(x) * mask, len(x)), fs

    return _map_samples(df, f)


def resample(df: DataFrame, rate: float = 100.0) -> DataFrame:
    """To another rate by cutting or padding the spectrum."""

    def f(x: np.ndarray, fs: float) -> tuple[np.ndarray, float]:
        n = round(len(x) * rate / fs)
        if not len(x) or n == len(x):
            return x, rate
        spec = np.fft.rfft(x)
        out = np.zeros(n // 2 + 1, complex)
        m = min(len(spec), len(out))
        out[:m] = spec[:m]
        return np.fft.irfft(out, n) * n / len(x), rate

    return _map_samples(df, f)


def fill_gaps(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One trace for each key from its segments (t0, fs, samples); gaps are filled by straight lines, overlaps take the later segment."""
    kinds = dict(segments.dtypes)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t0")
        fs, t0 = float(rows["fs"].iloc[0]), float(rows["t0"].iloc[0])
        at = np.concatenate([np.round((t - t0) * fs).astype(int) + np.arange(len(s)) for t, s in zip(rows["t0"], rows["samples"], strict=True)])
        value = np.concatenate([np.asarray(s, float) for s in rows["samples"]])
        known = dict(zip(at.tolist(), value.tolist(), strict=True))
        xs = np.array(sorted(known))
        full = np.interp(np.arange(xs[0], xs[-1] + 1), xs, [known[i] for i in xs.tolist()])
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "t0": t0, "fs": fs, "samples": full}])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", t0 double, fs double, samples array<double>"
    return segments.groupBy(*keys).applyInPandas(merged, schema)


#: Poles, zeros and gain of the Wood-Anderson seismometer, from ground velocity. Fixed values.
WOOD_ANDERSON = ([-5.49779 - 5.60886j, -5.49779 + 5.60886j], [0j], 2080.0)


def simulate_wood_anderson(df: DataFrame, poles: list[complex], zeros: list[complex], gain: float, water_db: float = 60.0) -> DataFrame:
    """The trace an instrument recorded, as a Wood-Anderson seismometer would have: spectra divided with a water level."""

    def answer(s: np.ndarray, p: list[complex], z: list[complex], g: float) -> np.ndarray:
        out = np.full(len(s), g, complex)
        for x in z:
            out *= s - x
        for x in p:
            out /= s - x
        return out

    def f(x: np.ndarray, fs: float) -> tuple[np.ndarray, float]:
        s = 2j * np.pi * np.fft.rfftfreq(len(x), 1 / fs)
        own = answer(s, poles, zeros, gain)
        size = np.abs(own)
        level = size.max() * 10 ** (-water_db / 20)
        safe = np.where(size < level, level * np.exp(1j * np.angle(own)), own)
        spec = np.fft.rfft(x - x.mean()) / safe * answer(s, *WOOD_ANDERSON)
        spec[0] = 0
        return np.fft.irfft(spec, len(x)), fs

    return _map_samples(df, f)


def pair_delay(pairs: DataFrame, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """``delay`` (s) and ``coherence`` of two windows (a, b, fs) from the slope of their smoothed cross-spectrum's phase."""

    @F.pandas_udf("delay double, coherence double")
    def measured(a: pd.Series, b: pd.Series, fs: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, rate in zip(a, b, fs, strict=True):
            x, y = (np.asarray(v, float) - np.mean(v) for v in (x, y))
            w = np.hanning(len(x))
            fx, fy, freq = np.fft.rfft(x * w), np.fft.rfft(y * w), np.fft.rfftfreq(len(x), 1 / rate)
            smooth = lambda v: np.convolve(v, np.ones(5) / 5, "same")
            cross, px, py = smooth(fx * np.conj(fy)), smooth(np.abs(fx) ** 2), smooth(np.abs(fy) ** 2)
            band = (freq >= low) & (freq <= high)
            coh = np.abs(cross) / np.sqrt(px * py + 1e-300)
            weight = coh[band] ** 2 * np.abs(cross[band])
            om = 2 * np.pi * freq[band]
            top = (weight * om * np.unwrap(np.angle(cross[band]))).sum()
            out.append((top / max((weight * om * om).sum(), 1e-300), float(coh[band].mean()) if band.any() else 0.0))
        return pd.DataFrame(out, columns=["delay", "coherence"])

    return pairs.withColumn("m", measured("a", "b", "fs")).select("*", "m.delay", "m.coherence").drop("m")


def arrival_sample(pick: Column, origin: Column, fs: Column, lead: float = 50.0) -> Column:
    """Index of an arrival in a trace that starts ``lead`` seconds before the origin; cut, not rounded."""
    return ((pick - (origin - lead)) * fs).cast("int")


def pick_weight(prob: Column) -> Column:
    return F.least(F.greatest(((1 - prob) / 0.7 * 4).cast("int") - 1, F.lit(0)), F.lit(3))


def split_midnight(start: Column, end: Column) -> Column:
    """One (start, end) or, across midnight, two."""
    day = F.date_trunc("day", start) + F.expr("interval 1 day")
    w = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(end <= day, F.array(w(start, end))).otherwise(F.array(w(start, day), w(day, end)))


def preferred_channels(inventory: DataFrame, keys: list[str], order: tuple[str, ...] = ("HH", "BH", "EH")) -> DataFrame:
    """The first band of the order that each key has."""
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.substring("channel", 1, 2))
    return inventory.where(rank > 0).groupBy(*keys).agg(F.min_by(F.substring("channel", 1, 2), rank).alias("band"))


def overlapping(traces: DataFrame, t0: float, t1: float, channel: str = ".*") -> DataFrame:
    """Traces that touch the time span, of channels that match."""
    end = F.col("t0") + F.array_size("samples") / F.col("fs")
    return traces.where((F.col("t0") < t1) & (end > t0) & F.col("channel").rlike(f"^(?:{channel})$"))
