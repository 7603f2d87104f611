"""Paths of trips: codes, simplification, typical paths of lanes, projection, departures from the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import paths as P
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR
from wayfold.sources.trails import DRIVES_SQL, drives

#: Fixes of the tables are hours apart, so times are in hours; distances are those of a fleet.
RULES = {"confirm_us": 8 * HOUR, "silence_us": 36 * HOUR}
LONG_STOP_US, LEAST_PLAN_M = 12 * HOUR, 10_000.0


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paths(drives(spark, sf_dir), "trip", "lane")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = P.simplified(P.typical_paths(_paths(spark, sf_dir)), 25.0)
    return plans.withColumn("metres", P.path_metres("lats", "lons"))


@query(f"WITH {DRIVES_SQL} SELECT trip, CAST(row_number() OVER (PARTITION BY trip ORDER BY us, event_id) - 1 AS INTEGER) AS seq, lat6, lon6 FROM drives")
def g16_polyline_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as polyline text and back: the corners in order."""
    coded = _paths(spark, sf_dir).select("trip", P.encoded("lats", "lons").alias("line"))
    return coded.select("trip", F.explode(P.decoded("line")).alias("p")).select("trip", "p.seq", "p.lat6", "p.lon6")


@query()
def g13_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the corners that shape them within 25 m."""
    found = P.simplified(_paths(spark, sf_dir), 25.0)
    return found.select("trip", "points", F.size("lats").alias("kept"), P.encoded("lats", "lons").alias("line"))


@query()
def g15_typical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of each lane that lies closest to the others."""
    return P.typical_paths(_paths(spark, sf_dir)).select("lane", "trip", F.round("score", 3).alias("score"), "trips")


@query()
def g14_chainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix on the plan of its lane: how far off, and how far along."""
    found = P.projected(drives(spark, sf_dir), _plans(spark, sf_dir))
    return found.select("trip", "event_id", F.round("offset_m", 2).alias("offset_m"), F.round("chain_m", 2).alias("chain_m"))


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standstills: from a fix to the next one less than 100 m from it."""
    w = Window.partitionBy("trip").orderBy("us", "event_id")
    return P.with_odometer(drives(spark, sf_dir)).withColumn("start_us", F.lag("us").over(w)).where("start_us IS NOT NULL AND leg < 100").select("trip", "start_us", F.col("us").alias("end_us"))


def _episodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fixes, plans = drives(spark, sf_dir), _plans(spark, sf_dir)
    raw = P.departures(fixes, plans, **RULES)
    return plans, raw, P.episodes(raw, fixes, plans, _stops(spark, sf_dir), long_stop_us=LONG_STOP_US)


@query()
def m10_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures from the plan with two thresholds, confirmation and rejoining, and what kind each was (M11)."""
    _, _, found = _episodes(spark, sf_dir)
    return found.withColumns({c: F.round(c, 2) for c in ("driven_m", "planned_m", "extra_m", "max_offset_m")})


@query()
def m12_route_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trip against its lane's plan: status, extra distance, departures, adherence."""
    plans, raw, found = _episodes(spark, sf_dir)
    out = P.analysis(drives(spark, sf_dir), plans, raw, found, LEAST_PLAN_M)
    return out.withColumns({c: F.round(c, 2) for c in ("driven_m", "plan_m", "off_m", "max_offset_m", "extra_pct", "adherence_pct")})
