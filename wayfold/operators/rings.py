"""Checks of outlines: edges that cross, and the radius of the largest circle inside."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayfold.operators.zones import _ROOM, METRE6, _distances


def first_crossing(lats: np.ndarray, lons: np.ndarray) -> tuple[int, int] | None:
    """The first pair (i, j) of edges that properly cross, i first; edges that only touch do not. Whole coordinates, so exact.

    A sweep over x: an edge is only held against those that begin before it ends, and of these against those of its height.
    """
    n = len(lats)
    if n < 4:
        return None
    x1, y1 = np.asarray(lons, np.int64), np.asarray(lats, np.int64)
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    order = np.argsort(np.minimum(x1, x2), kind="stable")
    left, right = np.minimum(x1, x2)[order], np.maximum(x1, x2)[order]
    low, high = np.minimum(y1, y2)[order], np.maximum(y1, y2)[order]
    until = np.searchsorted(left, right, side="right")
    best: tuple[int, int] | None = None
    for k in range(n):
        others = np.arange(k + 1, until[k])
        others = others[(low[others] <= high[k]) & (high[others] >= low[k])]
        if len(others) == 0:
            continue
        i, j = np.full(len(others), order[k]), order[others]
        side = lambda a, b, p, q: np.sign((x2[a] - x1[a]) * (q - y1[a]) - (y2[a] - y1[a]) * (p - x1[a]))  # noqa: E731, ARG005
        cross = (side(i, j, x1[j], y1[j]) * side(i, j, x2[j], y2[j]) < 0) & (side(j, i, x1[i], y1[i]) * side(j, i, x2[i], y2[i]) < 0)
        for other in j[cross].tolist():
            a, b = sorted((int(order[k]), other))
            if b - a > 1 and not (a == 0 and b == n - 1) and (best is None or (a, b) < best):
                best = (a, b)
    return best


def inscribed_radius(lats: np.ndarray, lons: np.ndarray, cap: float = 200.0, precision: float = 0.5) -> float:
    """Metres from the deepest point inside a ring to its edge, to ``precision``, no more than ``cap``."""
    return inscribed_radii([lats], [lons], cap, precision)[0]


def inscribed_radii(lats: list[np.ndarray], lons: list[np.ndarray], cap: float = 200.0, precision: float = 0.5) -> list[float]:
    """The same for many rings. Those with as many corners are searched side by side, each as if alone, so that a step of all is one calculation."""
    out = [0.0] * len(lats)
    alike: dict[int, list[int]] = {}
    for k, ring in enumerate(lats):
        alike.setdefault(len(ring), []).append(k)
    for n, own in alike.items():
        step = max(1, _ROOM // (4 * max(n, 1)))
        for at in range(0, len(own) if n >= 3 else 0, step):
            some = own[at : at + step]
            found = _side_by_side([np.asarray(lats[k], np.float64) for k in some], [np.asarray(lons[k], np.float64) for k in some], cap, precision)
            for k, radius in zip(some, found):
                out[k] = radius
    return out


def _side_by_side(lats: list[np.ndarray], lons: list[np.ndarray], cap: float, precision: float) -> list[float]:
    """Best first: of each ring the square that could hold the deepest point is split, until none could beat the best by ``precision``."""
    ys, xs = np.array(lats), np.array(lons)
    y0, x0 = ys[:, 0], xs[:, 0]
    tall, broad = METRE6, np.array([METRE6 * math.cos(math.radians(v * 1e-6)) for v in y0.tolist()])

    def depth(k: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return -_distances(ys[k] - (y / tall + y0[k])[:, None], xs[k] - (x / broad[k] + x0[k])[:, None], y0[k][:, None])

    best, squares = [0.0] * len(lats), [[] for _ in lats]
    for k in range(len(lats)):
        box = ((xs[k].min() - x0[k]) * broad[k], (xs[k].max() - x0[k]) * broad[k], (ys[k].min() - y0[k]) * tall, (ys[k].max() - y0[k]) * tall)
        side = min(box[1] - box[0], box[3] - box[2])
        if side <= 0:
            continue
        half = side / 2
        x, y = (a.ravel() for a in np.meshgrid(np.arange(box[0] + half, box[1] + half, side), np.arange(box[2] + half, box[3] + half, side)))
        d = depth(np.full(len(x) + 1, k), np.append(x, ((xs[k] - x0[k]) * broad[k]).mean()), np.append(y, ((ys[k] - y0[k]) * tall).mean()))
        best[k] = float(d.max())
        squares[k] = [(-(v + half * math.sqrt(2)), a, b, half) for a, b, v in zip(x.tolist(), y.tolist(), d[:-1].tolist())]
        heapify(squares[k])
    active = list(range(len(lats)))
    while active:
        split = []
        for k in active:
            if squares[k] and best[k] < cap:
                hope, a, b, half = heappop(squares[k])
                if -hope - best[k] > precision:
                    split.append((k, a, b, half / 2))
        active = [k for k, *_ in split]
        if not active:
            break
        k, a, b, half = (np.array(v)[:, None] for v in zip(*split))
        x, y = a + half * np.array([-1, 1, -1, 1]), b + half * np.array([-1, -1, 1, 1])
        d = depth(np.repeat(k.ravel(), 4), x.ravel(), y.ravel()).reshape(-1, 4)
        for (k, _, _, half), top, *rows in zip(split, d.max(1).tolist(), x.tolist(), y.tolist(), d.tolist()):
            best[k] = max(best[k], top)
            for a, b, v in zip(*rows):
                if v + half * math.sqrt(2) - best[k] > precision:
                    heappush(squares[k], (-(v + half * math.sqrt(2)), a, b, half))
    return [max(0.0, min(v, cap)) for v in best]


def checked(zones: DataFrame, cap: float = 200.0, precision: float = 0.5) -> DataFrame:
    """(zone, crossing_a, crossing_b, inradius_m): the edges of a zone (lats, lons) that cross first, null if none do, and its inscribed radius."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lats, lons = list(frame["lats"]), list(frame["lons"])
            radii = inscribed_radii(lats, lons, cap, precision)
            out = [(zone, *(first_crossing(y, x) or (None, None)), radius) for zone, y, x, radius in zip(frame["zone"].tolist(), lats, lons, radii)]
            yield pd.DataFrame(out, columns=["zone", "crossing_a", "crossing_b", "inradius_m"]).astype({"crossing_a": "Int64", "crossing_b": "Int64"})

    return zones.where("lats is not null and lons is not null").select("zone", "lats", "lons").mapInPandas(run, "zone long, crossing_a int, crossing_b int, inradius_m double")


def inscribed(zones: DataFrame, cap: float = 200.0, precision: float = 0.5) -> DataFrame:
    """(zone, inradius_m) alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"zone": frame["zone"], "inradius_m": inscribed_radii(list(frame["lats"]), list(frame["lons"]), cap, precision)})

    return zones.where("lats is not null and lons is not null").select("zone", "lats", "lons").mapInPandas(run, "zone long, inradius_m double")


def crossed(zones: DataFrame) -> DataFrame:
    """(zone, crossing_a, crossing_b) alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(zone, *(first_crossing(lats, lons) or (None, None))) for zone, lats, lons in zip(frame["zone"].tolist(), frame["lats"], frame["lons"])]
            yield pd.DataFrame(out, columns=["zone", "crossing_a", "crossing_b"]).astype({"crossing_a": "Int64", "crossing_b": "Int64"})

    return zones.where("lats is not null and lons is not null").select("zone", "lats", "lons").mapInPandas(run, "zone long, crossing_a int, crossing_b int")
