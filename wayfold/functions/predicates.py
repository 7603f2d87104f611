"""Filters that requests are made of, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label that lists show for a value nobody reported.
UNKNOWN = "(unknown)"
#: The rollup that stands for all scopes; limits that a request may choose for roads, and the one taken otherwise.
ALL_SCOPES, ROAD_LIMITS, ROAD_LIMIT = 0, (40, 50, 60, 70, 80), 60


def in_days(c: Column, first: str, last: str) -> Column:
    """Inclusive days as a half-open range, which scans can push down."""
    return (c >= F.to_date(F.lit(first))) & (c < F.date_add(F.to_date(F.lit(last)), 1))


def all_of(*tests: Column | None) -> Column:
    """The conjunction of the tests that were asked for."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def scoped(c: Column, scope: int | None) -> Column:
    """Rows of one scope; without one, the rows of the rollup over all."""
    return c == (ALL_SCOPES if scope is None else scope)


def of_class(c: Column, chosen: str) -> Column:
    return F.lit(True) if chosen == "all" else c == chosen


def equals_label(c: Column, label: str) -> Column:
    """Equality with what a list shows: the unknown label means null."""
    return c.isNull() if label == UNKNOWN else c == label


def snapped(value: int, allowed: tuple[int, ...] = ROAD_LIMITS, default: int = ROAD_LIMIT) -> int:
    """A limit that is not offered becomes the default."""
    return value if value in allowed else default


def ordering(sort: str, order: str, allowed: dict[str, Column], default: str) -> Column:
    """A sort key from a whitelist; unknown keys fall back, nulls come last either way."""
    key = allowed.get(sort, allowed[default])
    return key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()


def implausible(lat: Column, lon: Column) -> Column:
    """Why a position cannot be true; null where it can."""
    return (
        F.when(lat.isNull() | lon.isNull(), "missing")
        .when((F.abs(lat) < 0.01) & (F.abs(lon) < 0.01), "zero island")
        .when(~lat.between(-90, 90) | ~lon.between(-180, 180), "out of range")
    )


def scale_of(area_m2: Column) -> Column:
    return F.when(area_m2 < 1e4, "micro").when(area_m2 < 1e6, "site").when(area_m2 < 1e7, "campus").otherwise("regional")
