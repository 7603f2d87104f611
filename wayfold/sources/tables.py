"""Readers of the driver's tables, and the telemetry views over them with the SQL that defines the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.scalars import micros

MOVING = ("click", "view", "purchase")
HOUR = 3_600_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One row per fix: vehicle, us, moving, speed in hundredths, k, and coordinates made from them.
PINGS_SQL = """pings AS (
  SELECT event_id, user_id AS vehicle, epoch_us(ts) AS us, event_type,
         event_type IN ('click', 'view', 'purchase') AS moving,
         CAST(round(value * 100) AS BIGINT) AS speed,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("vehicle"),
        micros("ts").alias("us"),
        "event_type",
        F.col("event_type").isin(*MOVING).alias("moving"),
        F.round(F.col("value") * 100).cast("long").alias("speed"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )


PLACED_SQL = PINGS_SQL + """, placed AS (
  SELECT *, 20 + (vehicle % 97) / 10.0::DOUBLE + speed / 100000.0::DOUBLE AS lat, 75 + (k % 53) / 10.0::DOUBLE AS lon FROM pings)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.lit(20) + (F.col("vehicle") % 97) / F.lit(10.0) + F.col("speed") / F.lit(100000.0)
    return pings(spark, sf_dir).withColumns({"lat": lat, "lon": F.lit(75) + (F.col("k") % 53) / F.lit(10.0)})


#: One row per stay: a supplier's site, an order as vehicle, from the ship date for as many hours as the quantity.
STAYS_SQL = """stays AS (
  SELECT l_suppkey AS site, l_orderkey AS vehicle, l_linenumber AS seq, epoch_us(l_shipdate) AS enter,
         epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000000 AS leave,
         l_returnflag AS flag, l_linestatus AS status, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost, l_partkey AS part
  FROM lineitem)"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    enter = micros("l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"),
        F.col("l_orderkey").alias("vehicle"),
        F.col("l_linenumber").alias("seq"),
        enter.alias("enter"),
        (enter + F.col("l_quantity").cast("long") * HOUR).alias("leave"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost"),
        F.col("l_partkey").alias("part"),
    )


#: One row per trip: an order with its customer, lane (customer's nation to the first line's supplier's nation) and times.
TRIPS_SQL = """lines AS (
  SELECT l_orderkey AS trip, count(*) AS stops, sum(CAST(l_quantity AS BIGINT)) AS qty, min(l_shipdate) AS started, max(l_shipdate) AS ended,
         arg_min(l_suppkey, (l_linenumber, l_suppkey, l_partkey)) AS carrier,
         max(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 END) AS on_time
  FROM lineitem GROUP BY l_orderkey),
trips AS (
  SELECT o_orderkey AS trip, o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS booked,
         CAST(round(o_totalprice * 100) AS BIGINT) AS price, stops, qty, started, ended, carrier, on_time,
         date_diff('day', CAST(started AS DATE), CAST(ended AS DATE)) AS days,
         c_nationkey AS origin, s_nationkey AS dest
  FROM orders LEFT JOIN lines ON trip = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = carrier)"""


def trips(spark: SparkSession, sf_dir: str, lanes: bool = True) -> DataFrame:
    """``lanes``: with origin and dest, which take two more joins."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.min("l_shipdate").alias("started"),
        F.max("l_shipdate").alias("ended"),
        F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("carrier"),
        F.max(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "N", 1)).alias("on_time"),
    )
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trip"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("booked"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("price"),
    )
    days = F.datediff(F.to_date("ended"), F.to_date("started")).cast("long")
    met = orders.join(lines, "trip", "left").withColumn("days", days)
    if not lanes:
        return met
    who = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("origin"))
    by = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("carrier"), F.col("s_nationkey").alias("dest"))
    return met.join(who, "customer", "left").join(by, "carrier", "left")
