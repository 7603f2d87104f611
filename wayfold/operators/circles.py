"""Circles of any size against series: which were touched, then crossings of those alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.scalars import EARTH_M, haversine_m
from wayfold.operators.zones import METRE6

#: Distances that are measured at a time.
_ROOM = 1 << 18


def _metres(a: str, b: str):
    return haversine_m(*(F.col(c) * 1e-6 for c in (f"lat6{a}", f"lon6{a}", f"lat6{b}", f"lon6{b}")))


def _tasks(df: DataFrame) -> int:
    """By their bytes alone Spark would give rows that are much work to few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def touched(fixes: DataFrame, circles: DataFrame) -> DataFrame:
    """(vehicle, circle, radius, lat6_c, lon6_c): circles (circle, lat6, lon6, radius) that a vehicle has a fix in. A circle is copied to the cells that it covers, of a size that suits it."""
    tall, wide = F.col("radius") / METRE6, F.col("radius") / (METRE6 * F.greatest(F.cos(F.radians(F.col("lat6") * 1e-6)), F.lit(0.01)))
    level = F.greatest(F.lit(0), F.ceil(F.log2(2 * wide)).cast("int"))
    sized = circles.withColumns({"level": level, "tall": tall, "wide": wide})
    levels = [r.level for r in sized.select("level").distinct().collect()]  # one a doubling of size
    side = F.expr("shiftleft(1L, level)")
    span = lambda c, reach: F.sequence(F.floor((F.col(c) - F.col(reach)) / side), F.floor((F.col(c) + F.col(reach)) / side))
    spread = sized.withColumn("cy", F.explode(span("lat6", "tall"))).withColumn("cx", F.explode(span("lon6", "wide")))
    spread = spread.select("level", "cy", "cx", "circle", "radius", "tall", "wide", F.col("lat6").alias("lat6_c"), F.col("lon6").alias("lon6_c"))
    own = fixes.select("vehicle", "lat6", "lon6", F.explode(F.array(*[F.lit(x) for x in sorted(levels) or [0]])).alias("level"))
    own = own.withColumns({"cy": F.floor(F.col("lat6") / side), "cx": F.floor(F.col("lon6") / side)})
    # Dealt by number: few bytes of fixes and circles meet in many pairs. Most of these are told apart by the box of a circle.
    met = own.repartition(_tasks(fixes), "level", "cy", "cx").join(spread.hint("merge"), ["level", "cy", "cx"])
    boxed = (F.abs(F.col("lat6") - F.col("lat6_c")) <= 1.05 * F.col("tall")) & (F.abs(F.col("lon6") - F.col("lon6_c")) <= 1.05 * F.col("wide"))
    met = met.where(F.when(boxed, _metres("", "_c") <= F.col("radius")))
    return met.select("vehicle", "circle", "radius", "lat6_c", "lon6_c").distinct()


class _Touched:
    """All circles that a vehicle touched, each with the state of ``trackers.CircleRuns``, stepped side by side."""

    def __init__(self, circles: list[np.ndarray], confirm_us: int, escape: float):
        self.circle, self.radius, lat6, lon6 = circles
        self.confirm_us, self.escape = confirm_us, escape
        self.lat, self.lon = np.radians(lat6 * 1e-6), np.radians(lon6 * 1e-6)
        self.cos = np.cos(self.lat)
        n = len(self.circle)
        self.believed, self.inside = np.zeros(n, bool), np.zeros(n, bool)
        self.since, self.before, self.furthest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        self.last_us: int | None = None
        self.quiet = False

    def walk(self, us: np.ndarray, lat6: np.ndarray, lon6: np.ndarray) -> Iterator[tuple[int, str, int]]:
        """(circle, kind, us) of what the fixes confirm, in order."""
        most = max(1, _ROOM // len(self.circle))
        for at in range(0, len(us), most):
            own = slice(at, at + most)
            lat, lon = np.radians(lat6[own] * 1e-6)[:, None], np.radians(lon6[own] * 1e-6)[:, None]
            h = np.sin((self.lat - lat) / 2) ** 2 + np.cos(lat) * self.cos * np.sin((self.lon - lon) / 2) ** 2
            radii = 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))) / self.radius
            inside = radii <= 1.0
            for k, (now, any_inside) in enumerate(zip(us[own].tolist(), inside.any(1).tolist())):
                # Outside of all, and believed to be: nothing can change.
                if any_inside or not self.quiet:
                    yield from self._step(now, radii[k], inside[k])
                    self.quiet = not (any_inside or self.believed.any())
                self.last_us = now

    def _step(self, us: int, radii: np.ndarray, inside: np.ndarray) -> list[tuple[int, str, int]]:
        if self.last_us is None:
            self.believed, new, before = inside.copy(), np.ones(len(inside), bool), us
        else:
            new, before = inside != self.inside, self.last_us
        self.inside = inside
        self.since[new], self.before[new], self.furthest[new] = us, before, 0.0
        self.furthest = np.fmax(self.furthest, radii)
        turned = np.flatnonzero((inside != self.believed) & ((us - self.since >= self.confirm_us) | ~inside & (self.furthest > self.escape)))
        self.believed[turned] = inside[turned]
        return [(int(self.circle[k]), "enter", int(self.since[k])) if inside[k] else (int(self.circle[k]), "exit", int(self.before[k])) for k in turned]


def crossings(fixes: DataFrame, circles: DataFrame, confirm_us: int, escape: float) -> DataFrame:
    """(vehicle, circle, kind, us): confirmed crossings of every circle that a vehicle touched, over all of its fixes; see ``trackers.CircleRuns``.

    The first pass finds the pairs; the second walks each vehicle once beside all of its circles, so that neither fixes
    nor circles are copied for each other. A task holds the circles of one vehicle, not its fixes.
    """
    none = F.lit(0).cast("long")
    own = touched(fixes, circles).select("vehicle", F.lit(0).alias("side"), none.alias("us"), none.alias("event_id"), F.col("lat6_c").alias("lat6"), F.col("lon6_c").alias("lon6"), "circle", F.col("radius").cast("double").alias("radius"))
    rows = fixes.select("vehicle", F.lit(1).alias("side"), "us", "event_id", "lat6", "lon6", none.alias("circle"), F.lit(0.0).alias("radius")).where("us is not null and lat6 is not null and lon6 is not null")
    both = own.unionByName(rows).where("vehicle is not null").repartition(_tasks(fixes), "vehicle").sortWithinPartitions("vehicle", "side", "us", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, state = None, [], None
        for frame in frames:
            vehicle, side, circle, radius, us, lat6, lon6 = (frame[c].to_numpy() for c in ("vehicle", "side", "circle", "radius", "us", "lat6", "lon6"))
            ends = [*(np.flatnonzero((np.diff(vehicle) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(frame)] if len(frame) else []
            out: list[tuple] = []
            at = 0
            for to in ends:
                if vehicle[at] != current:
                    current, held, state = vehicle[at], [], None
                if not side[at]:
                    held.append([a[at:to] for a in (circle, radius, lat6, lon6)])
                elif held:
                    state = state or _Touched([np.concatenate(a) for a in zip(*held)], confirm_us, escape)
                    out += [(current, *x) for x in state.walk(us[at:to], lat6[at:to], lon6[at:to])]
                at = to
            yield pd.DataFrame(out, columns=["vehicle", "circle", "kind", "us"])

    return both.select("vehicle", "side", "us", "lat6", "lon6", "circle", "radius").mapInPandas(run, "vehicle long, circle long, kind string, us long")
