"""First arrivals in a layered earth: the direct ray by its ray parameter, and head waves along faster layers below."""

from __future__ import annotations

import numpy as np

#: Layers of a velocity table; a gradient is cut into steps of this many kilometres.
MOST_LAYERS, STEP_KM = 10_000, 0.5


def layers_of(rows: list[dict], velocity: str, deepest: float = 700.0) -> tuple[np.ndarray, np.ndarray]:
    """(tops, velocities) of constant layers. ``rows``: depth, the velocity and, if there is one, ``<velocity>_grad`` (km/s per km)."""
    rows = sorted((r for r in rows if r["depth"] is not None and r[velocity]), key=lambda r: r["depth"])
    tops, speeds = [], []
    for i, r in enumerate(rows):
        grad = r.get(f"{velocity}_grad") or 0.0
        end = rows[i + 1]["depth"] if i + 1 < len(rows) else deepest
        n = max(1, int(np.ceil((end - r["depth"]) / STEP_KM))) if grad else 1
        for k in range(n):
            tops.append(r["depth"] + (end - r["depth"]) * k / n)
            speeds.append(r[velocity] + grad * (end - r["depth"]) * (k + 0.5) / n if grad else r[velocity])
    if not tops:
        raise ValueError("the velocity model has no layers")
    return np.array(tops, float), np.array(speeds, float)


def _thickness(tops: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Of each layer between two depths, row by row. The first layer goes on upwards, the last downwards."""
    top, end = np.r_[-np.inf, tops[1:]], np.r_[tops[1:], np.inf]
    return np.maximum(0.0, np.minimum(lower[:, None], end) - np.maximum(upper[:, None], top))


def first_arrival(x: np.ndarray, source: np.ndarray, receiver: np.ndarray, tops: np.ndarray, speeds: np.ndarray) -> np.ndarray:
    """Seconds from a source to a receiver, at depths in km (above sea level negative), ``x`` km apart along the surface."""
    x = np.abs(np.asarray(x, float))
    upper, lower = np.minimum(source, receiver).astype(float), np.maximum(source, receiver).astype(float)
    h = _thickness(tops, upper, lower)
    at = np.clip(np.searchsorted(tops, lower, side="right") - 1, 0, None)
    flat = h.sum(axis=1) < 1e-9
    on_way = np.where(h > 0, speeds, 0.0)
    fast = np.where(flat, speeds[at], on_way.max(axis=1))
    own = np.where(flat, 1.0, np.where(on_way == fast[:, None], h, 0.0).sum(axis=1))
    # The tangent in the fastest layer lies between 0 and what that layer alone would need.
    low, high = np.zeros_like(x), x / own
    ratio = np.where(h > 0, speeds / fast[:, None], 0.0)
    for _ in range(60):
        u = (low + high) / 2
        q = (u / np.sqrt(1 + u * u))[:, None] * ratio
        far = (h * q / np.sqrt(np.maximum(1e-300, 1 - q * q))).sum(axis=1) > x
        low, high = np.where(far, low, u), np.where(far, u, high)
    u = (low + high) / 2
    q = (u / np.sqrt(1 + u * u))[:, None] * ratio
    direct = np.where(flat, x / fast, (h / speeds / np.sqrt(np.maximum(1e-300, 1 - q * q))).sum(axis=1))
    best = direct
    for k in range(1, len(tops)):
        below = tops[k] >= lower - 1e-9
        if not below.any():
            continue
        path = _thickness(tops, upper, np.full_like(lower, tops[k])) + _thickness(tops, lower, np.full_like(lower, tops[k]))
        sin = np.where(path > 0, speeds / speeds[k], 0.0)
        ok = below & (sin.max(axis=1) < 1)
        cos = np.sqrt(np.maximum(1e-300, 1 - sin * sin))
        head = x / speeds[k] + (path * cos / speeds).sum(axis=1)
        ok &= x >= (path * sin / cos).sum(axis=1)
        best = np.where(ok & (head < best), head, best)
    return best
