"""Rebuilds of summaries, pending sets, shares of shared events, seeding of fences and rows behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import encoded_steps
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, STAYS_SQL, TRIPS_SQL, pings, read, stays, trips

DAY = 24 * HOUR


def _n():
    return F.count(F.lit(1))


@query(f"WITH {TRIPS_SQL} SELECT customer, count(*) AS n, sum(price) AS price, min(booked) AS since FROM trips GROUP BY 1", whole=("price",))
def k07_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary rebuilt in full from the facts, for an overwrite of its table."""
    return trips(spark, sf_dir, lanes=False).groupBy("customer").agg(_n().alias("n"), F.sum("price").alias("price"), F.min("booked").alias("since"))


@query(f"""WITH {TRIPS_SQL}, tallied AS (SELECT trip, stops - CASE WHEN trip % 5 = 0 THEN 1 ELSE 0 END AS seen FROM trips WHERE trip % 3 <> 0)
SELECT CASE WHEN seen IS NULL THEN 'pending' WHEN seen <> coalesce(stops, 0) THEN 'stale' ELSE 'done' END AS state, count(*) AS n, sum(coalesce(stops, 0)) AS stops
FROM trips LEFT JOIN tallied USING (trip) GROUP BY 1""", whole=("stops",))
def c06_pending_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trips an extraction still has to take up: without a tally, or with one that no longer agrees."""
    facts = trips(spark, sf_dir, lanes=False).select("trip", "stops")
    late = F.when(F.col("trip") % 5 == 0, 1).otherwise(0)
    tallied = facts.where("trip % 3 <> 0").select("trip", (F.col("stops") - late).alias("seen"))
    has = F.coalesce("stops", F.lit(0))
    state = F.when(F.col("seen").isNull(), "pending").when(F.col("seen") != has, "stale").otherwise("done")
    return facts.join(tallied, "trip", "left").groupBy(state.alias("state")).agg(_n().alias("n"), F.sum(has).alias("stops"))


@query(f"""WITH {TRIPS_SQL}, cut AS (
  SELECT status, CASE WHEN origin = dest THEN 'local' WHEN dest IS NULL THEN 'open' ELSE 'zonal' END AS class, price, days FROM trips)
SELECT coalesce(class, 'all') AS class, coalesce(status, 'all') AS status, count(*) AS n, sum(price) AS price, max(days) AS longest
FROM cut GROUP BY GROUPING SETS ((class), (status), (class, status), ())""", whole=("price",))
def c19_feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the trip list by class, by status, by both and overall, in one pass."""
    kind = F.when(F.col("origin") == F.col("dest"), "local").when(F.col("dest").isNull(), "open").otherwise("zonal")
    cube = trips(spark, sf_dir).select("status", kind.alias("class"), "price", "days").cube("class", "status")
    found = cube.agg(_n().alias("n"), F.sum("price").alias("price"), F.max("days").alias("longest"))
    return found.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("class", "status")})


@query(f"WITH {TRIPS_SQL} SELECT customer, count(*) AS n, sum(CASE WHEN trip % 11 = 0 THEN price + 1 ELSE price END) AS price FROM trips GROUP BY 1", whole=("price",))
def c21_synced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips that changed name the customers whose summary is made anew; all others keep the row they had."""
    before = trips(spark, sf_dir, lanes=False).select("trip", "customer", "price")
    now = before.withColumn("price", F.when(F.col("trip") % 11 == 0, F.col("price") + 1).otherwise(F.col("price")))
    old = before.groupBy("customer").agg(_n().alias("n"), F.sum("price").alias("price"))
    touched = now.where("trip % 11 = 0").select("customer").distinct()
    new = now.join(touched, "customer", "left_semi").groupBy("customer").agg(_n().alias("n"), F.sum("price").alias("price"))
    return old.join(touched, "customer", "left_anti").unionByName(new)


@query(f"""WITH {STAYS_SQL}, spots AS (
  SELECT site, site % 90 * 100000 + part % 700 AS lat, site % 70 * 100000 + part % 500 AS lon FROM stays),
centres AS (SELECT site, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, stddev_pop(lat) AS spread FROM spots GROUP BY 1)
SELECT site, n, CAST(round(lat) AS BIGINT) AS lat, CAST(round(lon) AS BIGINT) AS lon,
       CAST(least(greatest(round(spread * 1.5), 100), 290) AS BIGINT) AS radius,
       CASE WHEN site % 10 = 0 THEN 'manual' WHEN n < 5 THEN 'too_few' WHEN abs(lat - site % 90 * 100000 - 350) > 40 THEN 'far' ELSE 'seeded' END AS decision
FROM centres""")
def c26_seeded_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles from the centre and spread of the stops of a site, unless set by hand, too few, or far from where the site should be."""
    lat, lon = F.col("site") % 90 * 100_000, F.col("site") % 70 * 100_000
    spots = stays(spark, sf_dir).select("site", (lat + F.col("part") % 700).alias("lat"), (lon + F.col("part") % 500).alias("lon"))
    centres = spots.groupBy("site").agg(_n().alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.stddev_pop("lat").alias("spread"))
    far = F.abs(F.col("lat") - lat - 350) > 40
    decision = F.when(F.col("site") % 10 == 0, "manual").when(F.col("n") < 5, "too_few").when(far, "far").otherwise("seeded")
    radius = F.least(F.greatest(F.round(F.col("spread") * 1.5), F.lit(100.0)), F.lit(290.0)).cast("long")
    return centres.select("site", "n", F.round("lat").cast("long").alias("lat"), F.round("lon").cast("long").alias("lon"), radius.alias("radius"), decision.alias("decision"))


@query(f"""WITH {PINGS_SQL} SELECT event_id, vehicle AS asset, us // 1000000 AS at_s, CASE WHEN speed BETWEEN 0 AND 16000 THEN speed END AS speed,
       k % 360 AS heading, CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'on' WHEN 'error' THEN 'off' ELSE 'unknown' END AS ignition FROM pings""")
def c29_mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the feed under the names and in the bounds of the fix table; what is out of bounds is unknown."""
    ignition = F.when(F.col("event_type").isin("click", "view"), "on").when(F.col("event_type") == "error", "off").otherwise("unknown")
    speed = F.when(F.col("speed").between(0, 16_000), F.col("speed"))
    return pings(spark, sf_dir).select("event_id", F.col("vehicle").alias("asset"), F.floor(F.col("us") / 1_000_000).alias("at_s"), speed.alias("speed"), (F.col("k") % 360).alias("heading"), ignition.alias("ignition"))


@query(f"""WITH {STAYS_SQL} SELECT site, count(*) AS n, sum(CASE WHEN vehicle % 400 = 0 THEN 0 ELSE cost END) AS cost, count(DISTINCT vehicle) AS vehicles
FROM stays GROUP BY 1""", whole=("cost",))
def c34_touched_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that the trips of a new batch touch are rolled up again over all their rows; the other rollups stay as they are."""
    before = stays(spark, sf_dir).select("site", "vehicle", "cost")
    now = before.withColumn("cost", F.when(F.col("vehicle") % 400 == 0, 0).otherwise(F.col("cost")))
    rolled = [_n().alias("n"), F.sum("cost").alias("cost"), F.countDistinct("vehicle").alias("vehicles")]
    touched = now.where("vehicle % 400 = 0").select("site").distinct()
    new = now.join(touched, "site", "left_semi").groupBy("site").agg(*rolled)
    return before.groupBy("site").agg(*rolled).join(touched, "site", "left_anti").unionByName(new)


@query(f"""WITH {STAYS_SQL} SELECT vehicle // 500 AS chunk, count(DISTINCT vehicle) AS trips, sum((leave - enter) // {HOUR}) AS stop_hours,
       sum(CASE WHEN flag = 'R' THEN (leave - enter) // {HOUR} ELSE 0 END) AS loading_hours FROM stays GROUP BY 1""", whole=("stop_hours", "loading_hours"))
def c35_phases_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase totals by chunks of trips, the unit in which phases are rebuilt."""
    hours = F.floor((F.col("leave") - F.col("enter")) / HOUR)
    loading = F.when(F.col("flag") == "R", hours).otherwise(0)
    chunk = F.floor(F.col("vehicle") / 500).alias("chunk")
    return stays(spark, sf_dir).groupBy(chunk).agg(F.countDistinct("vehicle").alias("trips"), F.sum(hours).alias("stop_hours"), F.sum(loading).alias("loading_hours"))


@query(f"""WITH {TRIPS_SQL}, rolled AS (SELECT customer, priority, count(*) AS n, sum(price) AS price FROM trips GROUP BY ALL),
figures AS (SELECT priority AS family, sum(n) AS n, sum(price) AS figure FROM rolled GROUP BY 1),
behind AS (SELECT o_orderpriority AS family, count(*) AS rows_behind, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS recount FROM orders GROUP BY 1)
SELECT figures.family AS family, figure, recount, rows_behind, figure = recount AND n = rows_behind AS proven FROM figures JOIN behind ON figures.family IS NOT DISTINCT FROM behind.family""", whole=("figure", "recount"))
def c55_proof_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure of each family out of its rollup, beside the recount of the records behind it."""
    rolled = trips(spark, sf_dir, lanes=False).groupBy("customer", "priority").agg(_n().alias("n"), F.sum("price").alias("price"))
    figures = rolled.groupBy(F.col("priority").alias("family")).agg(F.sum("n").alias("n"), F.sum("price").alias("figure"))
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    behind = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("f")).agg(_n().alias("rows_behind"), F.sum(price).alias("recount"))
    met = figures.join(behind, F.col("family").eqNullSafe(F.col("f")))
    return met.select("family", "figure", "recount", "rows_behind", ((F.col("figure") == F.col("recount")) & (F.col("n") == F.col("rows_behind"))).alias("proven"))


@query(f"""WITH {STAYS_SQL}, events_of AS (SELECT site, enter // {DAY} AS day, count(DISTINCT vehicle) AS sharers, max(leave) - min(enter) AS span FROM stays GROUP BY ALL)
SELECT vehicle, count(*) AS shared, sum(720720 // sharers) AS parts, sum(span // {HOUR}) AS hours
FROM (SELECT DISTINCT vehicle, site, enter // {DAY} AS day FROM stays) JOIN events_of USING (site, day) GROUP BY 1""", whole=("parts", "hours"))
def c60_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each physical event (a site on a day) is shared in equal parts by the trips that saw it; a whole has 720,720 parts."""
    seen = stays(spark, sf_dir).select("site", "vehicle", "enter", "leave", F.floor(F.col("enter") / DAY).alias("day"))
    found = seen.groupBy("site", "day").agg(F.countDistinct("vehicle").alias("sharers"), (F.max("leave") - F.min("enter")).alias("span"))
    parts, hours = F.floor(F.lit(720_720) / F.col("sharers")), F.floor(F.col("span") / HOUR)
    return seen.select("vehicle", "site", "day").distinct().join(found, ["site", "day"]).groupBy("vehicle").agg(_n().alias("shared"), F.sum(parts).alias("parts"), F.sum(hours).alias("hours"))


@query(f"""WITH {TRIPS_SQL} SELECT carrier, trip, started, days, price, CAST(count(*) OVER w AS BIGINT) AS of_trips, CAST(sum(price) OVER w AS BIGINT) AS of_price,
       row_number() OVER (PARTITION BY carrier ORDER BY price DESC, trip) AS place FROM trips WHERE carrier IS NOT NULL
WINDOW w AS (PARTITION BY carrier) QUALIFY place <= 10""")
def c70_carrier_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten dearest trips of each carrier beside the totals of all of its trips."""
    facts = trips(spark, sf_dir, lanes=False).where("carrier is not null").select("carrier", "trip", "started", "days", "price")
    totals = facts.groupBy("carrier").agg(_n().alias("of_trips"), F.sum("price").alias("of_price"))
    ranked = facts.withColumn("place", F.row_number().over(Window.partitionBy("carrier").orderBy(F.desc("price"), "trip"))).where("place <= 10")
    return ranked.join(totals, "carrier")


@query(f"""WITH {STAYS_SQL} SELECT vehicle, seq, site, enter, leave, (leave - enter) // 60000000 AS minutes,
       CASE WHEN flag = 'R' THEN 'A' WHEN flag = 'N' THEN 'B' ELSE 'none' END AS phase, (leave - enter) // {HOUR} > 24 AS counted FROM stays""")
def c72_hold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind the holds of a trip, each with its phase and whether it counts."""
    held = F.col("leave") - F.col("enter")
    phase = F.when(F.col("flag") == "R", "A").when(F.col("flag") == "N", "B").otherwise("none")
    return stays(spark, sf_dir).select("vehicle", "seq", "site", "enter", "leave", F.floor(held / 60_000_000).alias("minutes"), phase.alias("phase"), (F.floor(held / HOUR) > 24).alias("counted"))


_ZIGZAG = "CASE WHEN step < 0 THEN -2 * step - 1 ELSE 2 * step END"
_CHUNKS = " || ".join(f"CASE WHEN {i} = 0 OR z >> {5 * i} > 0 THEN chr(CAST(63 + ((z >> {5 * i}) & 31) + CASE WHEN z >> {5 * i + 5} > 0 THEN 32 ELSE 0 END AS INTEGER)) ELSE '' END" for i in range(7))


@query(f"""WITH {PINGS_SQL}, steps AS (
  SELECT vehicle, event_id, us, speed - coalesce(lag(speed) OVER w, 0) AS step FROM pings WHERE speed IS NOT NULL
  WINDOW w AS (PARTITION BY vehicle, us // {DAY} ORDER BY us, event_id)),
coded AS (SELECT vehicle, event_id, us, {_CHUNKS} AS code FROM (SELECT *, {_ZIGZAG} AS z FROM steps))
SELECT vehicle, us // {DAY} AS day, string_agg(code, '' ORDER BY us, event_id) AS line FROM coded GROUP BY 1, 2""")
def g16_encoded_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the series of a vehicle's day in the text code of polylines."""
    day = F.floor(F.col("us") / DAY)
    w = Window.partitionBy("vehicle", "day").orderBy("us", "event_id")
    df = pings(spark, sf_dir).where("speed is not null").withColumn("day", day)
    coded = df.select("vehicle", "day", "us", "event_id", encoded_steps(F.col("speed") - F.coalesce(F.lag("speed").over(w), F.lit(0))).alias("code"))
    parts = F.array_sort(F.collect_list(F.struct("us", "event_id", "code")))
    return coded.groupBy("vehicle", "day").agg(F.array_join(F.transform(parts, lambda x: x["code"]), "").alias("line"))
