"""Operators over ordered series: gaps, islands, episodes, folds. All are window functions over one key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.trackers import CircleRuns, FirstExit, Reach, Tracker, Visits

MINUTE = 60_000_000


def series(key: str | list[str], *order: str) -> Window:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def with_gap(df: DataFrame, key: str, order: list[str], us: str = "us", cap_us: int | None = None) -> DataFrame:
    """Credit each row with the time since the row before it, capped; 0 for the first."""
    gap = F.coalesce(F.col(us) - F.lag(us).over(series(key, *order)), F.lit(0))
    return df.withColumn("gap_us", F.least(gap, F.lit(cap_us)) if cap_us is not None else gap)


def islands(df: DataFrame, key: str | list[str], order: list[str], starts: Column, name: str = "grp") -> DataFrame:
    """Number the runs of a series; ``starts`` is true on the first row of a run."""
    run = series(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("__starts").over(run)).drop("__starts")


def changed(column: str, key: str | list[str], order: list[str]) -> Column:
    """Whether the value differs from the row before; true on the first row."""
    before = F.lag(column).over(series(key, *order))
    first = F.row_number().over(series(key, *order)) == 1
    return first | ~F.col(column).eqNullSafe(before)


def episodes(df: DataFrame, key: str, order: list[str], active: Column, silence_us: int, us: str = "us") -> DataFrame:
    """Runs of active rows; a row that is not active, or a silence longer than ``silence_us``, ends a run. Gives active rows with their run."""
    w = series(key, *order)
    marked = df.withColumn("__on", active)
    before, gap = F.lag("__on").over(w), F.col(us) - F.lag(us).over(w)
    starts = F.col("__on") & (before.isNull() | ~before | (gap > silence_us))
    return islands(marked, key, order, F.coalesce(starts, F.lit(False))).where("__on").drop("__on")


def running_total(df: DataFrame, key: str, order: list[str], step: str, name: str = "total") -> DataFrame:
    return df.withColumn(name, F.sum(F.coalesce(F.col(step), F.lit(0))).over(series(key, *order).rowsBetween(Window.unboundedPreceding, 0)))


def smoothed(df: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """Exponential smoothing of a series that fits a row (days, months): one fold over its ordered values."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value].cast("double"))
    fold = lambda acc, x: F.when(acc.isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * acc)
    return df.groupBy(key).agg(values.alias("__v")).select(key, F.aggregate("__v", F.lit(None).cast("double"), fold).alias("smoothed"))


def walked(df: DataFrame, key: str, columns: list[str], order: list[str], machine: Callable[[], object], schema: str) -> DataFrame:
    """Feed ``columns`` of each series, in order, to a machine of ``trackers``; ``schema`` has the key and what it gives.

    Spark sorts within partitions, and a task holds the state of one machine, however long its series is. Rows without
    a key are left out.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = None, None
        for frame in frames:
            out: list[tuple] = []
            for k, *row in zip(*(frame[c].tolist() for c in fed)):
                if own is None or k != current:
                    out += [(current, *x) for x in own.end()] if own is not None else []
                    current, own = k, machine()
                out += [(k, *x) for x in own.step(*row)]
            yield pd.DataFrame(out, columns=names)
        if own is not None:
            yield pd.DataFrame([(current, *x) for x in own.end()], columns=names)

    fed = [f"__{i}" for i in range(len(columns) + 1)]  # a column may be fed twice
    ordered = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *dict.fromkeys(order))
    return ordered.select(*[F.col(c).alias(name) for c, name in zip((key, *columns), fed)]).mapInPandas(run, schema)


def clean_trail(df: DataFrame, key: str, us: str, x: str, y: str, most_per_s: float) -> DataFrame:
    """(key, event_id, kept): whether an asset could have reached a row from the last accepted one; see ``trackers.Reach``."""
    return walked(df, key, [us, x, y, "event_id"], [us, "event_id"], lambda: Reach(most_per_s), f"{key} long, event_id long, kept boolean")


def crossings(df: DataFrame, key: str, us: str, distance: str, band: float, confirm_us: int, escape: float, silence_us: int) -> DataFrame:
    """Crossings of a zone with hysteresis and confirmation; see ``trackers.Tracker``, which streams use as well."""
    return walked(df, key, [us, distance], [us, "event_id"], lambda: Tracker(band, confirm_us, escape, silence_us), f"{key} long, kind string, us long")


def visits(df: DataFrame, key: str, us: str, distance: str, band: float, confirm_us: int, escape: float, silence_us: int) -> DataFrame:
    """The visits that the crossings make up, with those that began before the series or are open at its end."""
    make = lambda: Visits(Tracker(band, confirm_us, escape, silence_us))
    return walked(df, key, [us, distance], [us, "event_id"], make, f"{key} long, enter long, leave long, entry_seen boolean, open boolean")


def circle_crossings(df: DataFrame, key: str, us: str, distance: str, radius: float, confirm_us: int, escape: float) -> DataFrame:
    return walked(df, key, [us, distance], [us, "event_id"], lambda: CircleRuns(radius, confirm_us, escape), f"{key} long, kind string, us long")


def first_exit(df: DataFrame, key: str, us: str, distance: str, radius: float, confirm_us: int, escape: float) -> DataFrame:
    """The first confirmed exit of each series, or why there is none."""
    return walked(df, key, [us, distance], [us, "event_id"], lambda: FirstExit(CircleRuns(radius, confirm_us, escape)), f"{key} long, status string, us long")
