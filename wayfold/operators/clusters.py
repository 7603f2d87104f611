"""Density clustering over a grid, without the pairs of dense cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.components import components
from wayfold.sources.shared import staged


def dbscan(points: DataFrame, reach: int, least: int) -> DataFrame:
    """(id, cluster) of points (id, x, y; whole numbers): cluster is the least id of its core points; noise has none.

    Cells are so small that any two points of one are within ``reach``. So the points of a cell with ``least`` of them
    are all core, and the core points of a cell are one cluster, with no pair looked at. Pairs are made of points of
    sparse cells alone, fewer than ``least`` a cell, with those around. Whether two cells are linked is asked of the
    outermost core point of each row (or column) of one against those of the other, as many as a cell is wide at most:
    no point behind it can be nearer. Points at one place count as one with a weight.
    """
    side = max(1, math.isqrt(reach * reach // 2))
    steps = -(-reach // side)
    cell = lambda c: F.floor(F.col(c) / side)
    placed = points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumns({"cx": cell("x"), "cy": cell("y")})
    sized = placed.groupBy("cx", "cy").agg(F.sum("n").alias("held"))
    spots = staged(placed.join(sized, ["cx", "cy"]), "dbscan-spots")

    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1)]))
    sparse = spots.where(F.col("held") < least).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", around.alias("o"))
    sparse = sparse.select("a", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    within = lambda x, y: (F.col("ax") - F.col(x)) * (F.col("ax") - F.col(x)) + (F.col("ay") - F.col(y)) * (F.col("ay") - F.col(y)) <= reach * reach
    near = staged(sparse.join(spots.select(F.col("id").alias("b"), "x", "y", "n", "held", "cx", "cy"), ["cx", "cy"]).where(within("x", "y")).select("a", "b", "n", (F.col("held") >= least).alias("dense")), "dbscan-near")
    counted = near.groupBy("a").agg(F.sum("n").alias("seen")).where(F.col("seen") >= least).select(F.col("a").alias("id"))
    core = spots.where(F.col("held") >= least).unionByName(spots.join(counted, "id", "left_semi")).select("id", "x", "y", "cx", "cy")
    core = staged(core, "dbscan-core")
    cells = core.groupBy("cx", "cy").agg(F.min("id").alias("lead"))

    links = _linked(core, ("y", "x"), [(i, j) for i in range(1, steps + 1) for j in range(-steps, steps + 1)], within)
    links = links.unionByName(_linked(core, ("x", "y"), [(0, j) for j in range(1, steps + 1)], within))
    lead = lambda s: cells.select(F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"), F.col("lead").alias(s))
    found = components(links.join(lead("p"), ["px", "py"]).join(lead("q"), ["qx", "qy"]).select(F.col("p").alias("a"), F.col("q").alias("b")), "dbscan")
    named = cells.join(found, cells["lead"] == found["node"], "left").select("cx", "cy", F.coalesce("component", "lead").alias("label"))
    labels = core.join(named, ["cx", "cy"]).select("id", "label")
    border = near.select("a", F.col("b").alias("id")).join(labels, "id").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    spot = spots.select("id", "x", "y").join(labels, "id", "left").join(border, "id", "left").select("x", "y", F.coalesce("label", "near").alias("cluster"))
    return points.select("id", "x", "y").join(spot, ["x", "y"]).select("id", "cluster")


def _linked(core: DataFrame, by: tuple[str, str], offsets: list[tuple[int, int]], within) -> DataFrame:
    """(px, py, qx, qy): cells whose nearest core points are within reach. Of each line ``by[0]`` of a cell the last point along ``by[1]`` faces the first ones of the cells after it."""
    line, along = by
    last = core.groupBy("cx", "cy", line).agg(F.max(along).alias(along)).select(F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    first = core.groupBy("cx", "cy", line).agg(F.min(along).alias(along)).select(F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("x").alias("bx"), F.col("y").alias("by"))
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    spread = last.withColumn("o", to).withColumns({"qx": F.col("px") + F.col("o.i"), "qy": F.col("py") + F.col("o.j")}).drop("o")
    return spread.join(first, ["qx", "qy"]).where(within("bx", "by")).select("px", "py", "qx", "qy").distinct()
