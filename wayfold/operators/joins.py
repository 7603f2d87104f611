"""Joins that Spark has no operator for: as-of, interval, radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import haversine_m


def as_of(left: DataFrame, right: DataFrame, key: str, left_us: str, right_us: str, values: list[str]) -> DataFrame:
    """The newest row of ``right`` at or before each row of ``left``, by key: one sort of the union, no pairs."""
    carried = F.struct(F.col(right_us).alias("us"), *values)
    a = left.withColumns({"__us": F.col(left_us), "__side": F.lit(1), "__right": F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType)})
    b = right.select(key, F.col(right_us).alias("__us"), F.lit(0).alias("__side"), carried.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__us", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
    return found.select(*left.columns, F.col("__found.us").alias("as_of_us"), *[F.col(f"__found.{v}").alias(f"as_of_{v}") for v in values])


def cells(lat: Column, lon: Column, size: float) -> list[Column]:
    return [F.floor(lat / size).cast("long"), F.floor(lon / size).cast("long")]


def radius_join(points: DataFrame, places: DataFrame, metres: float, cell: float) -> DataFrame:
    """Pairs within ``metres``. Places are copied into the cells around them, points stay in theirs: an equi-join on cells.

    ``points`` has lat, lon; ``places`` has p_lat, p_lon. ``cell`` in degrees must be at least the radius.
    """
    y, x = cells(F.col("p_lat"), F.col("p_lon"), cell)
    near = F.array(*[F.struct((y + i).alias("cy"), (x + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = places.withColumn("__c", F.explode(near)).select("*", "__c.cy", "__c.cx").drop("__c")
    py, px = cells(F.col("lat"), F.col("lon"), cell)
    found = points.withColumns({"cy": py, "cx": px}).join(spread, ["cy", "cx"]).drop("cy", "cx")
    return found.withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))).where(F.col("metres") <= metres)


def known_by(asked: DataFrame, events: DataFrame, keys: list[str], asked_us: str, event_us: str, value: str, name: str) -> DataFrame:
    """What was known when it was asked: of the events of the same keys strictly before, their number (name_n) and the mean of ``value`` (name_mean).

    One sort of both sides per key, with running sums; no row sees itself or what came later. Null keys know nothing.
    """
    a = asked.withColumns({"__us": F.col(asked_us), "__event": F.lit(0), "__v": F.lit(None).cast("double")})
    b = events.select(*keys, F.col(event_us).alias("__us"), F.lit(1).alias("__event"), F.col(value).cast("double").alias("__v"))
    before = Window.partitionBy(*keys).orderBy("__us", "__event").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b.where(F.col("__us").isNotNull() & F.col("__v").isNotNull()), allowMissingColumns=True)
    summed = both.withColumns({f"{name}_n": F.count("__v").over(before), f"{name}_mean": F.avg("__v").over(before)}).where("__event = 0")
    told = F.lit(True)
    for k in keys:
        told = told & F.col(k).isNotNull()
    told = told & F.col("__us").isNotNull()
    return summed.select(*asked.columns, F.when(told, F.col(f"{name}_n")).otherwise(0).alias(f"{name}_n"), F.when(told, F.col(f"{name}_mean")).alias(f"{name}_mean"))
