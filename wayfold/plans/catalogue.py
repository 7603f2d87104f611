"""Named queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, whole: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of its oracle if there is one. ``whole``: sums that are cast to BIGINT."""
    if sql is not None and whole:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in whole)}) FROM ({sql})"

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def load() -> None:
    """Import the modules that register queries."""
    from wayfold.plans import (  # noqa: F401
        aggregate_queries,
        detail_queries,
        figure_queries,
        filter_queries,
        interval_queries,
        join_queries,
        master_queries,
        model_queries,
        name_queries,
        path_queries,
        register_queries,
        report_queries,
        scalar_queries,
        scene_queries,
        scorecard_queries,
        sequence_queries,
        stream_queries,
        upkeep_queries,
        upload_queries,
        zone_queries,
    )
