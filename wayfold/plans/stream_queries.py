"""Streams run to their end over files that arrive in slices of time: what a stream gives equals what SQL gives over all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.sequences import crossings
from wayfold.plans.catalogue import query
from wayfold.sources.shared import shared_folder
from wayfold.sources.tables import HOUR, PINGS_SQL, pings
from wayfold.streaming import live
from wayfold.streaming.runs import in_slices, to_the_end, updated_to_the_end


def _arriving(spark: SparkSession, df: DataFrame, by: str = "us") -> tuple[str, object]:
    """The rows as files in order of ``by``, and their schema."""
    source = shared_folder(spark, "arriving")
    in_slices(df, by, 3, source)
    return source, df.schema


def _updated(spark: SparkSession, df: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> DataFrame:
    source, schema = _arriving(spark, df)
    return updated_to_the_end(spark, source, schema, build, keys, name)


@query(f"WITH {PINGS_SQL} SELECT vehicle, us // (24 * {HOUR}) AS day, count(*) AS fixes, max(speed) AS fastest FROM pings GROUP BY ALL")
def t15_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days of a stream; days that go on are updated."""
    return _updated(spark, pings(spark, sf_dir), live.daily, ["vehicle", "day"], "daily")


@query(f"""WITH {PINGS_SQL}, w AS (SELECT unnest([us // {6 * HOUR}, us // {6 * HOUR} - 1, us // {6 * HOUR} - 2, us // {6 * HOUR} - 3]) * {6 * HOUR} AS start_us, speed FROM pings)
SELECT start_us, count(*) AS fixes, max(speed) AS peak FROM w GROUP BY 1""")
def t17_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day, every six hours, over a stream; open ones are updated."""

    def build(stream: DataFrame) -> DataFrame:
        out = live.event_time(stream).groupBy(F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("fixes"), F.max("speed").alias("peak"))
        return out.select(F.unix_micros("w.start").alias("start_us"), "fixes", "peak")

    return _updated(spark, pings(spark, sf_dir), build, ["start_us"], "sliding")


@query(f"""WITH {PINGS_SQL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY vehicle ORDER BY us, event_id) AS gap FROM pings),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY us, event_id) AS grp FROM g) SELECT vehicle, min(us) AS start_us, max(us) AS last_us, count(*) AS fixes FROM s GROUP BY vehicle, grp""")
def t16_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by silence, with the expression that streams use: those that are open at the end would wait in a stream."""
    return live.sessions(pings(spark, sf_dir), "12 hours")


@query(f"""WITH {PINGS_SQL}, l AS (SELECT event_id, vehicle, us, max(us) OVER (PARTITION BY vehicle ORDER BY event_id + (k % 5) * 20, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM pings)
SELECT event_id, vehicle FROM l WHERE newest IS NULL OR us > newest""")
def t05_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of arrival (some fixes come late), those that are not newer than all before them of their vehicle are dropped: keyed state over a stream."""
    df = pings(spark, sf_dir).select("event_id", "vehicle", "us", (F.col("event_id") + (F.col("k") % 5) * 20).alias("arrival"))
    source, schema = _arriving(spark, df, "arrival")
    return to_the_end(spark, source, schema, live.in_order, "in-order").select("event_id", "vehicle")


@query(f"""WITH {PINGS_SQL}, v AS (SELECT vehicle, event_type AS zone, us // {24 * HOUR} AS visit, max(speed) AS speed FROM pings GROUP BY ALL)
SELECT vehicle, zone, visit, 'restricted' AS kind FROM v WHERE zone = 'error' UNION ALL SELECT vehicle, zone, visit, 'overspeed' FROM v WHERE speed > 7000 AND zone IN ('error', 'click')""")
def t06_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a visit, however many fixes of the stream break a rule and in however many micro-batches they come."""
    zones = spark.createDataFrame([("error", True, 7_000), ("click", False, 7_000)], "zone string, restricted boolean, limit long")
    crossed = pings(spark, sf_dir).select("vehicle", F.col("event_type").alias("zone"), F.floor(F.col("us") / (24 * HOUR)).alias("visit"), "speed", "us")
    source, schema = _arriving(spark, crossed)
    return to_the_end(spark, source, schema, lambda stream: live.alerts(stream, zones), "alerts")


@query()
def m01_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone crossings with hysteresis and confirmation; the stream of ``streaming.live`` gives the same rows."""
    from wayfold.plans.figure_queries import _signed

    return crossings(_signed(spark, sf_dir), "vehicle", "us", "distance", 2_000.0, 6 * HOUR, 40_000.0, 48 * HOUR)
