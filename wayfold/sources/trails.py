"""Trails and zone outlines over the driver's tables, in whole micro-degrees, with the SQL that defines the same rows.

The tables hold no positions. A trail is the running sum of small steps drawn from the fixes of a vehicle, a zone an
outline around the place of a part; fifty zones and four vehicles share a neighbourhood at every scale, and zones nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.sources.tables import PINGS_SQL, pings, read

_PLACE_SQL = "{lat} AS {a}, {lon} AS {b}"
#: One row per fix: event_id, vehicle, us, speed (hundredths), lat6, lon6.
TRAILS_SQL = PINGS_SQL + """, trails AS (
  SELECT event_id, vehicle, us, speed,
         CAST(10000000 + ((vehicle // 4) % 20) * 500000 + ((vehicle * 71) % 997 - 498) * 200 + sum((k % 21 - 10) * 400) OVER w AS BIGINT) AS lat6,
         CAST(70000000 + ((vehicle // 80) % 20) * 500000 + ((vehicle * 37) % 991 - 495) * 200 + sum((speed % 19 - 9) * 400) OVER w AS BIGINT) AS lon6
  FROM pings WINDOW w AS (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))"""


def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("vehicle").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("vehicle")
    lat = 10_000_000 + (F.floor(v / 4) % 20) * 500_000 + ((v * 71) % 997 - 498) * 200 + F.sum((F.col("k") % 21 - 10) * 400).over(so_far)
    lon = 70_000_000 + (F.floor(v / 80) % 20) * 500_000 + ((v * 37) % 991 - 495) * 200 + F.sum((F.col("speed") % 19 - 9) * 400).over(so_far)
    return pings(spark, sf_dir).select("event_id", "vehicle", "us", "speed", lat.cast("long").alias("lat6"), lon.cast("long").alias("lon6"))


#: One row per zone: zone, lats, lons (corners in order), area2 (twice the area, squared micro-degrees), category, speed_limit, band (metres).
ZONES_SQL = """corners AS (
  SELECT p_partkey AS zone, i, p_type, p_size,
         CAST(10000000 + ((p_partkey // 50) % 20) * 500000 + ((p_partkey * 37) % 1009 - 504) * 200
              + round((9000 + (p_size * 571) % 27000) * (0.55::DOUBLE + 0.05::DOUBLE * ((p_partkey * 7 + i * 13) % 10)) * sin(2 * pi() * i / (5 + p_partkey % 8))) AS BIGINT) AS lat6,
         CAST(70000000 + ((p_partkey // 1000) % 20) * 500000 + ((p_partkey * 53) % 1013 - 506) * 200
              + round((9000 + (p_size * 571) % 27000) * (0.55::DOUBLE + 0.05::DOUBLE * ((p_partkey * 7 + i * 13) % 10)) * cos(2 * pi() * i / (5 + p_partkey % 8))) AS BIGINT) AS lon6
  FROM part, generate_series(0, 4 + p_partkey % 8) AS g(i)),
zones AS (
  SELECT zone, list(lat6 ORDER BY i) AS lats, list(lon6 ORDER BY i) AS lons,
         CASE any_value(p_type) WHEN 'PROMO' THEN 'restricted' WHEN 'LARGE' THEN 'high_risk' ELSE 'open' END AS category,
         CASE WHEN any_value(p_size) < 20 THEN 5000 END AS speed_limit, CAST(100 + (zone % 5) * 20 AS DOUBLE) AS band
  FROM corners GROUP BY zone)"""


def zones(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """All zones, or those of ``only`` (zone); outlines of others are not drawn."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    if only is not None:
        part = part.join(only.select(F.col("zone").alias("p_partkey")), "p_partkey", "left_semi")
    # A small file is one partition, and all that is done with its outlines would be one task.
    part = part.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    p, radius = F.col("p_partkey"), 9_000 + (F.col("p_size") * 571) % 27_000
    n = 5 + p % 8
    lat = 10_000_000 + (F.floor(p / 50) % 20) * 500_000 + ((p * 37) % 1009 - 504) * 200
    lon = 70_000_000 + (F.floor(p / 1000) % 20) * 500_000 + ((p * 53) % 1013 - 506) * 200

    def corners(at, wave):
        out = lambda i: radius * (F.lit(0.55) + F.lit(0.05) * ((p * 7 + i * 13) % 10)) * wave(2 * F.pi() * i / n)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: (at + F.round(out(i))).cast("long"))

    category = F.when(F.col("p_type") == "PROMO", "restricted").when(F.col("p_type") == "LARGE", "high_risk").otherwise("open")
    placed = part.select(
        p.alias("zone"), corners(lat, F.sin).alias("lats"), corners(lon, F.cos).alias("lons"), category.alias("category"),
        F.when(F.col("p_size") < 20, 5_000).cast("long").alias("speed_limit"), (100 + (p % 5) * 20).cast("double").alias("band"),
    )
    return placed.withColumn("area2", area2(F.col("lats"), F.col("lons")))


def area2(lats, lons):
    """Twice the area inside a ring of whole coordinates, exactly."""
    y, x = F.transform(lats, lambda a: a - F.get(lats, F.lit(0))), F.transform(lons, lambda a: a - F.get(lons, F.lit(0)))
    n = F.size(lats)
    twice = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, i) * F.get(y, (i + 1) % n) - F.get(x, (i + 1) % n) * F.get(y, i))
    return F.abs(F.aggregate(twice, F.lit(0).cast("long"), lambda a, b: a + b))


#: One row per fix of a drive along a lane of ten trips: zigzags with scatter, every ninth fix a standstill, side trips by blocks of six fixes.
DRIVES_SQL = PINGS_SQL + """, numbered AS (
  SELECT event_id, vehicle AS trip, vehicle // 10 AS lane, us, speed, row_number() OVER (PARTITION BY vehicle ORDER BY us, event_id) - 1 AS j FROM pings),
drives AS (
  SELECT trip, lane, event_id, us,
         CAST(12000000 + (lane % 100) * 100000 + (j - (j + trip) // 9) * 4000 + (speed % 37 - 18) * 10 AS BIGINT) AS lat6,
         CAST(72000000 + (lane // 100) * 1000000 + abs(((j - (j + trip) // 9) * 7 + lane) % 40 - 20) * 600 + (speed % 41 - 20) * 10
              + CASE WHEN ((j // 6) * 5 + trip * 3) % 7 = 0 THEN 9000 + (trip % 3) * 8000 ELSE 0 END AS BIGINT) AS lon6
  FROM numbered)"""


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    df = pings(spark, sf_dir).withColumns({"trip": F.col("vehicle"), "lane": F.floor(F.col("vehicle") / 10), "j": F.row_number().over(w).cast("long") - 1})
    along = F.col("j") - F.floor((F.col("j") + F.col("trip")) / 9)
    aside = F.when((F.floor(F.col("j") / 6) * 5 + F.col("trip") * 3) % 7 == 0, 9_000 + (F.col("trip") % 3) * 8_000).otherwise(0)
    lat = 12_000_000 + (F.col("lane") % 100) * 100_000 + along * 4_000 + (F.col("speed") % 37 - 18) * 10
    lon = 72_000_000 + F.floor(F.col("lane") / 100) * 1_000_000 + F.abs((along * 7 + F.col("lane")) % 40 - 20) * 600 + (F.col("speed") % 41 - 20) * 10 + aside
    return df.select("trip", "lane", "event_id", "us", lat.cast("long").alias("lat6"), lon.cast("long").alias("lon6"))
