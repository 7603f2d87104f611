"""Rates with honest denominators, intervals and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def known_rate(flag: Column) -> Column:
    """Share of 1 among known flags in percent; null when none is known. An aggregate."""
    return F.try_divide(100.0 * F.sum(F.when(flag == 1, 1).when(flag.isNotNull(), 0)), F.count(flag))


def per_reporting(total: Column, reporting: Column) -> Column:
    return F.try_divide(total, F.nullif(reporting, F.lit(0)))


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """A bound of the Wilson 95 % interval as a share; null without observations."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = hits / n
    z2 = Z95 * Z95
    centre = p + z2 / (2 * n)
    spread = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (centre + spread if upper else centre - spread) / (1 + z2 / n)


def smoothed_rate(hits: Column, n: Column, prior: Column, weight: float) -> Column:
    """A rate pulled towards ``prior`` by ``weight`` observations."""
    return (hits + weight * prior) / (n + weight)


def percent_rank_average(value: str, window, part) -> Column:
    """Ranks with ties averaged, as a share of the rows that have a value."""
    ties = F.count(F.lit(1)).over(part)
    return (F.rank().over(window) + (ties - 1) / 2.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rank_value(counts: DataFrame, keys: list[str], value: str, n: str, rank: Callable[[Column], Column]) -> DataFrame:
    """The value at a rank (from 1) that follows from the number of rows, from counts of distinct values."""
    order = Window.partitionBy(*keys).orderBy(value)
    so_far = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = counts.withColumn("__so_far", so_far).withColumn("__total", F.sum(n).over(Window.partitionBy(*keys)))
    return marked.where(F.col("__so_far") >= rank(F.col("__total"))).groupBy(*keys).agg(F.min(value).alias(value))
