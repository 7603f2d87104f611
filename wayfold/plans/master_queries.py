"""Masters of circles: the import of a client's list, and the crossings of circles by all series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import circles as C
from wayfold.operators.scenes import centroids
from wayfold.plans.catalogue import query
from wayfold.sources import masters as M
from wayfold.sources.tables import HOUR, read
from wayfold.sources.trails import trails, zones

_RAW_SQL = """raw AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name || ' ' || p_partkey % 300 END AS name,
         CASE p_partkey % 19 WHEN 0 THEN 'north' WHEN 1 THEN '95.5' WHEN 2 THEN CAST(70 + p_partkey % 20 AS VARCHAR) || '.25' ELSE CAST(8 + p_partkey % 25 AS VARCHAR) || '.5' END AS lat,
         CASE p_partkey % 19 WHEN 2 THEN CAST(8 + p_partkey % 25 AS VARCHAR) || '.5' WHEN 3 THEN '-20' ELSE CAST(70 + p_partkey % 20 AS VARCHAR) || '.25' END AS lon,
         CASE p_partkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 'wide' WHEN 2 THEN '10' WHEN 3 THEN '99999' ELSE CAST(100 + p_size * 10 AS VARCHAR) || '.7' END AS radius,
         CASE p_partkey % 29 WHEN 0 THEN 'Depot' WHEN 1 THEN NULL WHEN 2 THEN ' YARD ' ELSE 'Origin' END AS role
  FROM part)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as a client sends it: its own headers, and the faults that such lists have."""
    p = F.col("p_partkey")
    pick = lambda n, cases, rest: F.expr(f"CASE p_partkey % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {rest} END")
    north, east = "concat(cast(8 + p_partkey % 25 AS string), '.5')", "concat(cast(70 + p_partkey % 20 AS string), '.25')"
    return read(spark, sf_dir, "part").select(
        p.alias("No."),
        F.when(p % 41 == 0, " ").otherwise(F.concat("p_name", F.lit(" "), (p % 300).cast("string"))).alias("Location Name"),
        pick(19, {0: "'north'", 1: "'95.5'", 2: east}, north).alias("Unloading Point Latitude"),
        pick(19, {2: north, 3: "'-20'"}, east).alias("Unloading Point Longitude"),
        pick(23, {0: "NULL", 1: "'wide'", 2: "'10'", 3: "'99999'"}, "concat(cast(100 + p_size * 10 AS string), '.7')").alias("Geofence Radius (m)"),
        pick(29, {0: "'Depot'", 1: "NULL", 2: "' YARD '"}, "'Origin'").alias("TYPE"),
    )


_CHECKED_SQL = f"""{_RAW_SQL}, typed AS (
  SELECT nullif(upper(trim(name)), '') AS key, coalesce(lower(trim(role)), 'destination') AS role, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon,
         CASE WHEN radius IS NULL THEN 3000 ELSE CAST(trunc(TRY_CAST(radius AS DOUBLE)) AS INTEGER) END AS radius_m FROM raw),
checked AS (
  SELECT *, CASE WHEN key IS NULL THEN 'no name' WHEN lat IS NULL OR lon IS NULL THEN 'no place'
    WHEN lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN CASE WHEN lon BETWEEN 6 AND 37.5 AND lat BETWEEN 68 AND 97.5 THEN 'latitude and longitude look swapped' ELSE 'out of range' END
    WHEN NOT (lat BETWEEN 6 AND 37.5 AND lon BETWEEN 68 AND 97.5) THEN CASE WHEN lon BETWEEN 6 AND 37.5 AND lat BETWEEN 68 AND 97.5 THEN 'latitude and longitude look swapped' ELSE 'outside the area' END
    WHEN radius_m IS NULL THEN 'radius is no number' WHEN radius_m NOT BETWEEN 50 AND 50000 THEN 'radius out of bounds' WHEN role NOT IN ('origin', 'destination', 'yard') THEN 'unknown role' END AS reject
  FROM typed)"""
_BOX = (6.0, 68.0, 37.5, 97.5)


@query(f"WITH {_CHECKED_SQL} SELECT key, role, lat, lon, radius_m, reject FROM checked")
def s17_checked_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's circles with what is wrong with each."""
    return M.checked_circles(_raw(spark, sf_dir), _BOX).select("key", "role", "lat", "lon", "radius_m", "reject")


@query(f"""WITH {_CHECKED_SQL}, good AS (SELECT key, role, max((lat, lon, radius_m)) AS x FROM checked WHERE reject IS NULL GROUP BY ALL),
held AS (SELECT DISTINCT key, role FROM typed WHERE key IS NOT NULL AND radius_m % 3 = 0)
SELECT g.key, g.role, CASE WHEN h.key IS NULL THEN 'insert' ELSE 'update' END AS action, NOT EXISTS (SELECT 1 FROM part WHERE upper(p_name || ' ' || p_partkey % 100) = g.key) AS unmatched FROM good g LEFT JOIN held h ON h.key = g.key AND h.role = g.role""")
def s17_import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What importing them would do: new or replaced, and whether any trip uses the name."""
    checked = M.checked_circles(_raw(spark, sf_dir), _BOX)
    held = checked.where("key IS NOT NULL AND radius_m % 3 = 0").select("key", "role", F.lit(20.0).alias("lat"), F.lit(75.0).alias("lon"))
    used = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 100).cast("string")).alias("name"))
    return M.preview(checked, held, used).select("key", "role", "action", "unmatched")


@query()
def c27_circle_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of the circles around all zones by all trails: the touched pairs first, then each pair by itself."""
    around = centroids(zones(spark, sf_dir)).select(F.col("zone").alias("circle"), "lat6", "lon6", (500.0 + (F.col("zone") % 7) * 300).alias("radius"))
    return C.crossings(trails(spark, sf_dir), around, 8 * HOUR, 2.0)
