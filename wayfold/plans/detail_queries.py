"""Composite reads: lists and details of trips, vehicles, carriers, parties, sites and live positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import rates as R
from wayfold.operators import intervals as I
from wayfold.operators import sequences as S
from wayfold.plans.catalogue import query
from wayfold.plans.model_queries import booked_features
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, STAYS_SQL, TRIPS_SQL, pings, placed, read, stays, trips

_ORDER = ["us", "event_id"]
_W = "OVER (PARTITION BY vehicle ORDER BY us, event_id)"
DAY = 24 * HOUR


def _n() -> Column:
    return F.count(F.lit(1))


def _parts(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """Sections of one page as rows (part, name, n)."""
    rows = [df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), "n") for part, df, name in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"""WITH {PINGS_SQL}, l AS (SELECT *, us - lag(us) {_W} AS gap, lag(moving) {_W} AS was FROM pings)
SELECT vehicle, count(*) AS fixes, min(us) AS first_us, max(us) AS last_us, max(speed) AS peak, sum(CASE WHEN was THEN least(gap, {6 * HOUR}) ELSE 0 END) AS moving_us,
 count(*) FILTER (WHERE NOT moving AND was IS DISTINCT FROM false) AS stops, count(*) FILTER (WHERE gap > {12 * HOUR}) AS silences FROM l GROUP BY vehicle""", whole=("moving_us",))
def c01_trip_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement, stops and silences of each trail from one sorted pass."""
    w = S.series("vehicle", *_ORDER)
    df = pings(spark, sf_dir).withColumn("gap", F.col("us") - F.lag("us").over(w)).withColumn("was", F.lag("moving").over(w))
    return df.groupBy("vehicle").agg(
        _n().alias("fixes"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max("speed").alias("peak"),
        F.sum(F.when(F.col("was"), F.least("gap", F.lit(6 * HOUR))).otherwise(0)).alias("moving_us"),
        F.count_if(~F.col("moving") & F.coalesce(F.col("was"), F.lit(True))).alias("stops"),
        F.count_if(F.coalesce(F.col("gap") > 12 * HOUR, F.lit(False))).alias("silences"),
    )


_EPISODES = f"""f AS (SELECT *, speed > 4000 AS fast, lag(speed > 4000) {_W} AS was, us - lag(us) {_W} AS gap FROM pings),
g AS (SELECT *, sum(CASE WHEN fast AND (was IS NULL OR NOT was OR gap > {12 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM f),
e AS (SELECT vehicle, min(us) AS start_us, max(us) AS end_us, max(speed) AS peak, arg_max(k, (speed, event_id)) AS k FROM g WHERE fast GROUP BY vehicle, grp)"""


@query(f"""WITH {PINGS_SQL}, {_EPISODES} SELECT vehicle, start_us, end_us, peak, CASE WHEN k % 4 = 0 THEN 'plant' ELSE 'road' END AS zone, c_nationkey AS home
FROM e LEFT JOIN customer ON c_custkey = vehicle WHERE peak > CASE WHEN k % 4 = 0 THEN 4500 ELSE 6000 END ORDER BY peak DESC, vehicle, start_us LIMIT 200""")
def c02_speed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register of overspeed: peaks above the limit of their zone, worst first."""
    runs = S.episodes(pings(spark, sf_dir), "vehicle", _ORDER, F.col("speed") > 4000, 12 * HOUR)
    found = runs.groupBy("vehicle", "grp").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.max("speed").alias("peak"), F.max_by("k", F.struct("speed", "event_id")).alias("k"))
    plant = F.col("k") % 4 == 0
    over = found.where(F.col("peak") > F.when(plant, 4500).otherwise(6000)).withColumn("zone", F.when(plant, "plant").otherwise("road"))
    top = over.orderBy(F.desc("peak"), "vehicle", "start_us").limit(200)
    home = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vehicle"), F.col("c_nationkey").alias("home"))
    return home.join(F.broadcast(top), "vehicle", "right").select("vehicle", "start_us", "end_us", "peak", "zone", "home")


@query(f"""WITH {PINGS_SQL}, h AS (SELECT vehicle, CAST(speed // 1000 AS BIGINT) AS bin, count(*) AS n FROM pings WHERE event_id < (SELECT max(event_id) - 50 FROM pings) GROUP BY ALL)
SELECT vehicle, count(*) AS pings, coalesce(any_value(s.n), 0) AS rolled_up, count(*) - coalesce(any_value(s.n), 0) AS behind FROM pings LEFT JOIN (SELECT vehicle, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1) s USING (vehicle) GROUP BY vehicle""")
def c03_rollup_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fixes a rollup that stopped 50 fixes ago does not hold yet."""
    df = pings(spark, sf_dir)
    upto = df.agg((F.max("event_id") - 50).alias("upto"))
    marked = df.crossJoin(F.broadcast(upto))
    counts = marked.groupBy("vehicle").agg(_n().alias("pings"), F.count_if(F.col("event_id") < F.col("upto")).alias("rolled_up"))
    return counts.withColumn("behind", F.col("pings") - F.col("rolled_up"))


@query(f"""WITH {TRIPS_SQL}, t AS (SELECT * FROM trips WHERE carrier = 3)
SELECT 'month' AS part, strftime(booked, '%Y-%m') AS name, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'lane', CAST(dest AS VARCHAR), count(*) FROM t GROUP BY 2
UNION ALL SELECT 'weekday', CAST(extract('isodow' FROM booked) - 1 AS VARCHAR), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'customers', 'distinct', count(DISTINCT customer) FROM t
UNION ALL SELECT 'risk', CAST(trip AS VARCHAR), days FROM (SELECT trip, days FROM t ORDER BY days DESC NULLS LAST, trip LIMIT 10)""")
def c09_carrier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, lanes, rhythm, customers and the riskiest trips of one carrier."""
    t = trips(spark, sf_dir).where("carrier = 3")
    count = lambda c: t.groupBy(c.alias("name")).agg(_n().alias("n"))
    return _parts(
        ("month", count(F.date_format("booked", "yyyy-MM")), "name"),
        ("lane", count(F.col("dest")), "name"),
        ("weekday", count(F.weekday("booked")), "name"),
        ("customers", t.agg(F.countDistinct("customer").alias("n")).withColumn("name", F.lit("distinct")), "name"),
        ("risk", t.orderBy(F.col("days").desc_nulls_last(), "trip").limit(10).select("trip", F.col("days").alias("n")), "trip"),
    )


@query(f"""WITH {TRIPS_SQL}, c AS (SELECT carrier, count(*) AS n, sum(price) AS price, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS rate, median(days) AS days FROM trips WHERE carrier IS NOT NULL GROUP BY carrier)
SELECT carrier, s_name AS name, n, price, rate, days, CASE WHEN rate IS NULL THEN 'ungraded' WHEN rate >= 60 THEN 'A' WHEN rate >= 45 THEN 'B' ELSE 'C' END AS grade FROM c JOIN supplier ON s_suppkey = carrier WHERE n >= 5 AND s_name ILIKE '%0%'""", whole=("price",))
def c11_league_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers with a name that matches, enough trips, and what their grade rests on."""
    t = trips(spark, sf_dir, lanes=False).where("carrier is not null")
    c = t.groupBy("carrier").agg(_n().alias("n"), F.sum("price").alias("price"), R.known_rate(F.col("on_time")).alias("rate"), F.median("days").alias("days")).where("n >= 5")
    names = read(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%0%")).select(F.col("s_suppkey").alias("carrier"), F.col("s_name").alias("name"))
    grade = F.when(F.col("rate").isNull(), "ungraded").when(F.col("rate") >= 60, "A").when(F.col("rate") >= 45, "B").otherwise("C")
    return c.join(names, "carrier").withColumn("grade", grade)


@query(f"""WITH {TRIPS_SQL} SELECT c_custkey AS party, c_name AS name, count(trip) AS trips, count(DISTINCT carrier) AS carriers, max(booked) AS latest FROM customer LEFT JOIN trips ON customer = c_custkey
WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""")
def c13_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of one segment with their trips; those without any stay."""
    who = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))
    df = who.join(trips(spark, sf_dir, lanes=False), "customer", "left")
    return df.groupBy(F.col("customer").alias("party"), "name").agg(F.count("trip").alias("trips"), F.countDistinct("carrier").alias("carriers"), F.max("booked").alias("latest"))


@query(f"""WITH {TRIPS_SQL}, t AS (SELECT * FROM trips WHERE booked >= TIMESTAMP '1997-01-01')
SELECT * FROM (SELECT 'route' AS part, CAST(origin AS VARCHAR) || '>' || CAST(dest AS VARCHAR) AS name, count(*) AS n FROM t WHERE dest IS NOT NULL GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'carrier', CAST(carrier AS VARCHAR) AS name, count(*) AS n FROM t WHERE carrier IS NOT NULL GROUP BY 2 ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT 'recent', name, n FROM (SELECT CAST(trip AS VARCHAR) AS name, price AS n, booked FROM t ORDER BY booked DESC, trip LIMIT 10)""")
def c14_drill_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest routes and carriers and the latest trips of a period."""
    t = trips(spark, sf_dir).where("booked >= '1997-01-01'")
    route = F.concat_ws(">", F.col("origin").cast("string"), F.col("dest").cast("string"))
    top = lambda df, c: df.groupBy(c.alias("name")).agg(_n().alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return _parts(
        ("route", top(t.where("dest is not null"), route), "name"),
        ("carrier", top(t.where("carrier is not null"), F.col("carrier").cast("string")), "name"),
        ("recent", t.orderBy(F.desc("booked"), "trip").limit(10).select("trip", F.col("price").alias("n")), "trip"),
    )


@query(f"""WITH {PINGS_SQL}, v AS (SELECT vehicle, count(*) AS fixes, max(us) AS last_us, arg_max(event_type, (us, event_id)) AS last_status, max(speed) AS peak, count(DISTINCT us // {DAY}) AS days FROM pings GROUP BY vehicle)
SELECT v.*, c_name AS name, count(*) OVER () AS total FROM v LEFT JOIN customer ON c_custkey = vehicle ORDER BY fixes DESC, vehicle LIMIT 50 OFFSET 50""")
def c16_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of vehicles by activity, with the total."""
    v = pings(spark, sf_dir).groupBy("vehicle").agg(
        _n().alias("fixes"), F.max("us").alias("last_us"), F.max_by("event_type", F.struct("us", "event_id")).alias("last_status"),
        F.max("speed").alias("peak"), F.countDistinct(F.floor(F.col("us") / DAY)).alias("days"),
    )
    page = v.orderBy(F.desc("fixes"), "vehicle").offset(50).limit(50)
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vehicle"), F.col("c_name").alias("name"))
    named = names.join(F.broadcast(page), "vehicle", "right")
    return named.crossJoin(F.broadcast(v.agg(_n().alias("total")))).select("vehicle", "fixes", "last_us", "last_status", "peak", "days", "name", "total")


@query(f"""WITH {TRIPS_SQL} SELECT origin, dest, count(*) AS trips, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS rate, min(days) AS least_days, median(days) AS days, max(booked) AS latest
FROM trips WHERE status = 'F' AND dest IS NOT NULL GROUP BY ALL""")
def c18_route_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finished trips of each route took."""
    t = trips(spark, sf_dir).where("status = 'F' and dest is not null")
    return t.groupBy("origin", "dest").agg(
        _n().alias("trips"), R.known_rate(F.col("on_time")).alias("rate"), F.min("days").alias("least_days"), F.median("days").alias("days"), F.max("booked").alias("latest")
    )


@query(f"""WITH {PINGS_SQL}, p AS (SELECT * FROM pings WHERE moving) SELECT 'hour' AS part, CAST((us // {HOUR}) % 24 AS VARCHAR) AS name, count(*) AS n FROM p GROUP BY 2
UNION ALL SELECT 'band', CAST(speed // 1000 AS VARCHAR), count(*) FROM p GROUP BY 2 UNION ALL SELECT 'weekday', CAST((us // {DAY} + 3) % 7 AS VARCHAR), count(*) FROM p GROUP BY 2""")
def c20_driving_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, speed bands and weekdays of driving, from one pass over grouping sets."""
    p = pings(spark, sf_dir).where("moving").select((F.floor(F.col("us") / HOUR) % 24).alias("hour"), F.floor(F.col("speed") / 1000).alias("band"), ((F.floor(F.col("us") / DAY) + 3) % 7).alias("weekday"))
    counts = p.groupingSets([["hour"], ["band"], ["weekday"]], "hour", "band", "weekday").agg(_n().alias("n"), F.grouping("hour").alias("gh"), F.grouping("band").alias("gb"))
    part = F.when(F.col("gh") == 0, "hour").when(F.col("gb") == 0, "band").otherwise("weekday")
    return counts.select(part.alias("part"), F.coalesce("hour", "band", "weekday").cast("string").alias("name"), "n")


@query(f"""WITH {TRIPS_SQL}, k AS (SELECT trip, origin, dest, CASE WHEN trip % 6 = 0 THEN 0 ELSE qty END AS km FROM trips), a AS (SELECT origin, dest, sum(km) // count(*) AS usual FROM k WHERE km > 0 AND dest IS NOT NULL GROUP BY ALL)
SELECT trip, coalesce(nullif(km, 0), usual) AS km, km = 0 AND usual IS NOT NULL AS filled FROM k LEFT JOIN a USING (origin, dest)""", whole=("km",))
def c22_filled_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing distance is that of its route on average."""
    k = trips(spark, sf_dir).select("trip", "origin", "dest", F.when(F.col("trip") % 6 == 0, 0).otherwise(F.col("qty")).alias("km"))
    usual = k.where("km > 0 and dest is not null").groupBy("origin", "dest").agg(F.floor(F.sum("km") / _n()).alias("usual"))
    df = k.join(usual, ["origin", "dest"], "left")
    return df.select("trip", F.coalesce(F.nullif("km", F.lit(0)), "usual").alias("km"), ((F.col("km") == 0) & F.col("usual").isNotNull()).alias("filled"))


@query(f"""WITH {TRIPS_SQL}, p AS (SELECT trip, date_diff('day', CAST(booked AS DATE), CAST(started AS DATE)) AS a, days AS b FROM trips)
SELECT trip, a, b, a + b AS both_days, CASE WHEN a + b > 0 THEN 100.0 * a / (a + b) END AS understated_pct FROM p""")
def c23_hold_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days before and after the start, and how much of both a measure of the second alone leaves out."""
    a = F.datediff(F.to_date("started"), F.to_date("booked")).cast("long")
    df = trips(spark, sf_dir, lanes=False).select("trip", a.alias("a"), F.col("days").alias("b")).withColumn("both_days", F.col("a") + F.col("b"))
    return df.withColumn("understated_pct", F.when(F.col("both_days") > 0, F.lit(100.0) * F.col("a") / F.col("both_days")))


@query(f"""WITH {TRIPS_SQL} SELECT status, trip, days FROM trips WHERE days IS NOT NULL QUALIFY row_number() OVER (PARTITION BY status ORDER BY abs(days - 60), trip) = 1""")
def c28_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most typical trip of each status: an aggregate, not a sort of all trips."""
    t = trips(spark, sf_dir, lanes=False).where("days is not null")
    return t.groupBy("status").agg(F.min(F.struct(F.abs(F.col("days") - 60).alias("off"), "trip", "days")).alias("x")).select("status", "x.trip", "x.days")


@query(f"""WITH {TRIPS_SQL}, l AS (SELECT origin, dest, min(days) AS plan FROM trips WHERE dest IS NOT NULL GROUP BY ALL)
SELECT origin, dest, count(*) AS trips, sum(days - plan) AS over_days, count(*) FILTER (WHERE days > plan + 60) AS off_plan FROM trips JOIN l USING (origin, dest) GROUP BY ALL""", whole=("over_days",))
def c37_lanes_against_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of each lane against its best one."""
    t = trips(spark, sf_dir).where("dest is not null")
    plan = t.groupBy("origin", "dest").agg(F.min("days").alias("plan"))
    df = t.join(plan, ["origin", "dest"])
    return df.groupBy("origin", "dest").agg(_n().alias("trips"), F.sum(F.col("days") - F.col("plan")).alias("over_days"), F.count_if(F.col("days") > F.col("plan") + 60).alias("off_plan"))


@query(f"""WITH {TRIPS_SQL}, s AS (SELECT l_orderkey AS trip, count(DISTINCT l_suppkey) AS sites FROM lineitem WHERE l_quantity > 10 OR l_returnflag = 'R' GROUP BY 1)
SELECT trip, status, priority, days, coalesce(sites, 0) AS sites FROM trips LEFT JOIN s USING (trip) WHERE status = 'O' ORDER BY days DESC NULLS LAST, trip LIMIT 100""")
def c38_trip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of open trips with the sites they touched, by either of two facts; sites are counted for that page alone."""
    page = trips(spark, sf_dir, lanes=False).where("status = 'O'").orderBy(F.col("days").desc_nulls_last(), "trip").limit(100)
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 10 or l_returnflag = 'R'").select(F.col("l_orderkey").alias("trip"), "l_suppkey")
    sites = lines.join(F.broadcast(page.select("trip")), "trip", "left_semi").groupBy("trip").agg(F.countDistinct("l_suppkey").alias("sites"))
    return page.join(sites, "trip", "left").select("trip", "status", "priority", "days", F.coalesce("sites", F.lit(0)).alias("sites"))


@query(f"""WITH {PINGS_SQL} SELECT event_id, vehicle, us, CASE WHEN event_type = 'error' THEN 'fault' ELSE 'overspeed' END AS kind FROM pings WHERE event_type = 'error' OR speed > 8000
ORDER BY us DESC, event_id LIMIT 100 OFFSET 20""")
def c39_alert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = pings(spark, sf_dir).where("event_type = 'error' or speed > 8000").select("event_id", "vehicle", "us", F.when(F.col("event_type") == "error", "fault").otherwise("overspeed").alias("kind"))
    return alerts.orderBy(F.desc("us"), "event_id").offset(20).limit(100)


@query(f"""WITH {STAYS_SQL}, w AS (SELECT max(enter) - {90 * DAY} AS since FROM stays), r AS (SELECT stays.* FROM stays, w WHERE enter >= since)
SELECT vehicle, count(*) AS visits, count(DISTINCT site) AS sites, sum(leave - enter) AS inside_us, max(leave) AS last_us FROM r GROUP BY vehicle""", whole=("inside_us",))
def c40_entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles of the default window, the last 90 days of the data."""
    df = stays(spark, sf_dir)
    recent = df.crossJoin(F.broadcast(df.agg((F.max("enter") - 90 * DAY).alias("since")))).where("enter >= since")
    return recent.groupBy("vehicle").agg(_n().alias("visits"), F.countDistinct("site").alias("sites"), F.sum(F.col("leave") - F.col("enter")).alias("inside_us"), F.max("leave").alias("last_us"))


@query(f"""WITH {STAYS_SQL}, v AS (SELECT site, count(*) AS visits, median(leave - enter) AS dwell_us FROM stays GROUP BY site)
SELECT s_suppkey AS site, n_name AS state, coalesce(visits, 0) AS visits, dwell_us, CASE WHEN visits IS NULL THEN 'never' WHEN visits >= 600 THEN 'busy' ELSE 'used' END AS facet
FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN v ON site = s_suppkey WHERE n_regionkey IN (1, 2)""")
def c42_fence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of two regions with their activity."""
    v = stays(spark, sf_dir).groupBy("site").agg(_n().alias("visits"), F.median(F.col("leave") - F.col("enter")).alias("dwell_us"))
    states = read(spark, sf_dir, "nation").where("n_regionkey in (1, 2)").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
    sites = read(spark, sf_dir, "supplier").join(states, "s_nationkey").select(F.col("s_suppkey").alias("site"), "state").join(v, "site", "left")
    facet = F.when(F.col("visits").isNull(), "never").when(F.col("visits") >= 600, "busy").otherwise("used")
    return sites.select("site", "state", F.coalesce("visits", F.lit(0)).alias("visits"), "dwell_us", facet.alias("facet"))


@query(f"""WITH {PLACED_SQL}, n AS (SELECT max(us) AS newest FROM placed), l AS (SELECT vehicle, max(us) AS us, arg_max(lat, (us, event_id)) AS lat, arg_max(lon, (us, event_id)) AS lon, arg_max(moving, (us, event_id)) AS moving FROM placed GROUP BY vehicle)
SELECT vehicle, us, lat, lon, moving, us >= newest - {3 * DAY} AS live FROM l, n""")
def c45_live_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last position of each vehicle and whether it is still heard of."""
    df = placed(spark, sf_dir)
    last = df.groupBy("vehicle").agg(F.max(F.struct("us", "event_id", "lat", "lon", "moving")).alias("x")).select("vehicle", "x.us", "x.lat", "x.lon", "x.moving")
    newest = df.agg(F.max("us").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).select("vehicle", "us", "lat", "lon", "moving", (F.col("us") >= F.col("newest") - 3 * DAY).alias("live"))


@query(f"WITH {TRIPS_SQL} SELECT trip, qty FROM trips WHERE qty IS NOT NULL ORDER BY abs(qty - 123), trip LIMIT 1", whole=("qty",))
def c48_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir, lanes=False).where("qty is not null").orderBy(F.abs(F.col("qty") - 123), "trip").select("trip", "qty").limit(1)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500")
def c49_incremental_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that holds ids up to 500 takes what follows; a copy that runs again adds nothing twice."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    held = orders.where("o_orderkey <= 500")
    upto = held.agg(F.max("o_orderkey").alias("upto"))
    fresh = orders.crossJoin(F.broadcast(upto)).where("o_orderkey > upto").drop("upto")
    return fresh.join(held.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query(f"""WITH {TRIPS_SQL}, r AS (SELECT t.trip, count(s.days) AS n, avg(s.days) AS mean FROM trips t JOIN trips s ON s.origin = t.origin AND s.dest = t.dest AND s.ended < t.booked GROUP BY t.trip),
c AS (SELECT t.trip, count(s.on_time) AS n, avg(s.on_time) AS mean FROM trips t JOIN trips s ON s.carrier = t.carrier AND s.ended < t.booked GROUP BY t.trip)
SELECT trip, coalesce(r.n, 0) AS route_trips, coalesce(r.mean, 60.0::DOUBLE) AS route_days, coalesce(c.n, 0) AS carrier_trips, coalesce(c.mean, 0.5::DOUBLE) AS carrier_rate,
 extract('isodow' FROM booked) - 1 AS weekday, CASE WHEN extract('isodow' FROM booked) >= 6 THEN 1 ELSE 0 END AS weekend FROM trips LEFT JOIN r USING (trip) LEFT JOIN c USING (trip)""")
def c51_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of route, carrier and time as they were known when a trip was booked, with defaults where nothing was."""
    df = booked_features(trips(spark, sf_dir))
    day = F.weekday("booked").cast("long")
    known = lambda c, v, name: F.coalesce(c, F.lit(v)).alias(name)
    return df.select("trip", "route_n", known("route_mean", 60.0, "route_days"), "carrier_n", known("carrier_mean", 0.5, "carrier_rate"), day.alias("weekday"), (day >= 5).cast("int").alias("weekend")).withColumnsRenamed({"route_n": "route_trips", "carrier_n": "carrier_trips"})


@query(f"""WITH {TRIPS_SQL}, q AS (SELECT quantile_disc(days, 0.01) AS lo, quantile_disc(days, 0.99) AS hi FROM trips WHERE days IS NOT NULL)
SELECT trip, days, price, carrier, trip % 5 = 0 AS held_out FROM trips, q WHERE days BETWEEN lo AND hi AND on_time IS NOT NULL""")
def c52_training_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged trips without the outer percents, a fifth held out by id."""
    t = trips(spark, sf_dir, lanes=False).where("days is not null")
    counts = t.groupBy(F.lit(1).alias("one"), "days").agg(_n().alias("n"))
    bounds = [R.rank_value(counts, ["one"], "days", "n", lambda n, q=q: F.greatest(F.ceil(n * F.lit(q)), F.lit(1))).select(F.col("days").alias(name)) for q, name in ((0.01, "lo"), (0.99, "hi"))]
    inner = t.crossJoin(F.broadcast(bounds[0])).crossJoin(F.broadcast(bounds[1])).where("days between lo and hi and on_time is not null")
    return inner.select("trip", "days", "price", "carrier", (F.col("trip") % 5 == 0).alias("held_out"))


@query(f"""WITH {PINGS_SQL}, a AS (SELECT vehicle, count(DISTINCT us // {DAY}) AS days, count(*) FILTER (WHERE (us // {HOUR}) % 24 < 6) AS nights, count(*) FILTER (WHERE speed > 7000) AS fast, count(*) AS n FROM pings GROUP BY vehicle),
s AS (SELECT *, CASE WHEN nights >= 3 THEN 3 ELSE 0 END + CASE WHEN fast >= 2 THEN 2 ELSE 0 END + CASE WHEN days >= 7 THEN 2 ELSE 0 END + CASE WHEN n >= 15 THEN 2 ELSE 0 END AS score FROM a)
SELECT vehicle, score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS severity, concat_ws(',', CASE WHEN nights >= 3 THEN 'nights' END, CASE WHEN fast >= 2 THEN 'speed' END, CASE WHEN days >= 7 THEN 'streak' END, CASE WHEN n >= 15 THEN 'load' END) AS factors
FROM s WHERE score >= 4 ORDER BY score DESC, vehicle LIMIT 50""")
def c66_fatigue_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty highest scores with the rules that made them."""
    a = pings(spark, sf_dir).groupBy("vehicle").agg(
        F.countDistinct(F.floor(F.col("us") / DAY)).alias("days"), F.count_if(F.floor(F.col("us") / HOUR) % 24 < 6).alias("nights"), F.count_if(F.col("speed") > 7000).alias("fast"), _n().alias("n")
    )
    rules = {"nights": (F.col("nights") >= 3, 3), "speed": (F.col("fast") >= 2, 2), "streak": (F.col("days") >= 7, 2), "load": (F.col("n") >= 15, 2)}
    score = reduce(lambda x, y: x + y, [F.when(test, points).otherwise(0) for test, points in rules.values()])
    factors = F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, (test, _) in rules.items()])), ",")
    scored = a.withColumn("score", score).withColumn("factors", factors).where("score >= 4").orderBy(F.desc("score"), "vehicle").limit(50)
    return scored.select("vehicle", "score", F.when(F.col("score") >= 7, "high").when(F.col("score") >= 5, "medium").otherwise("low").alias("severity"), "factors")


@query("""WITH q(asked) AS (VALUES ('Customer#1'), ('customer#000000007'), ('Nobody'), (c7())), m AS (SELECT asked, c_name, CASE WHEN c_name = asked THEN 1 WHEN lower(c_name) = lower(asked) THEN 2 WHEN contains(lower(c_name), lower(asked)) THEN 3 END AS tier FROM q, customer),
b AS (SELECT asked, min(tier) AS tier FROM m GROUP BY asked), h AS (SELECT m.asked, m.c_name FROM m JOIN b ON b.asked = m.asked AND b.tier = m.tier)
SELECT q.asked, count(c_name) AS hits, CASE WHEN count(c_name) = 1 THEN min(c_name) END AS name FROM q LEFT JOIN h USING (asked) GROUP BY q.asked""".replace(", (c7())", ""))
def c68_client_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, else case-insensitive, else by substring; several hits are ambiguous. The questions are few and broadcast."""
    asked = spark.createDataFrame([("Customer#1",), ("customer#000000007",), ("Nobody",)], "asked string")
    low = lambda c: F.lower(F.col(c))
    tier = F.when(F.col("c_name") == F.col("asked"), 1).when(low("c_name") == low("asked"), 2).when(F.contains(low("c_name"), low("asked")), 3)
    met = read(spark, sf_dir, "customer").select("c_name").join(F.broadcast(asked), F.contains(low("c_name"), low("asked"))).withColumn("tier", tier)
    tiers = met.groupBy("asked", "tier").agg(_n().alias("hits"), F.min("c_name").alias("name"))
    best = tiers.groupBy("asked").agg(F.min(F.struct("tier", "hits", "name")).alias("x")).select("asked", "x.hits", "x.name")
    return asked.join(best, "asked", "left").select("asked", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("hits") == 1, F.col("name")).alias("name"))


@query(f"""WITH {STAYS_SQL}, w AS (SELECT site, leave - enter AS wait FROM stays WHERE status = 'F') SELECT site, count(*) AS n, sum(wait) AS total_us, max(wait) AS worst_us FROM w GROUP BY site""", whole=("total_us",))
def c44_proof_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure recounted from the records behind it, which are the same rows without the last aggregation."""
    records = stays(spark, sf_dir).where("status = 'F'").select("site", (F.col("leave") - F.col("enter")).alias("wait"))
    return records.groupBy("site").agg(_n().alias("n"), F.sum("wait").alias("total_us"), F.max("wait").alias("worst_us"))


@query(f"""WITH {STAYS_SQL}, m0 AS (SELECT *, max(leave) OVER (PARTITION BY vehicle ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stays),
m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY enter, leave ROWS UNBOUNDED PRECEDING) AS grp FROM m0),
u AS (SELECT vehicle, min(enter) AS enter, max(leave) AS leave FROM m1 GROUP BY vehicle, grp), c AS (SELECT vehicle, greatest(enter, {10000 * DAY}) AS a, least(leave, {10365 * DAY}) AS b FROM u)
SELECT vehicle, sum(b - a) AS inside_us FROM c WHERE a < b GROUP BY vehicle""", whole=("inside_us",))
def c41_clipped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time at places within a window, nested stays once."""
    df = stays(spark, sf_dir).select("vehicle", "enter", "leave")
    spans = I.merged(df.repartition(I.parts(df), "vehicle"), ["vehicle"])
    cut = spans.select("vehicle", F.greatest("enter", F.lit(10000 * DAY)).alias("a"), F.least("leave", F.lit(10365 * DAY)).alias("b")).where("a < b")
    return cut.groupBy("vehicle").agg(F.sum(F.col("b") - F.col("a")).alias("inside_us"))


@query(f"""WITH {TRIPS_SQL}, t AS (SELECT * FROM trips WHERE customer = 11)
SELECT 'carrier' AS part, CAST(carrier AS VARCHAR) AS name, count(*) AS n FROM t WHERE carrier IS NOT NULL GROUP BY 2 UNION ALL SELECT 'split', CASE on_time WHEN 1 THEN 'met' WHEN 0 THEN 'late' ELSE 'unknown' END, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'month', strftime(booked, '%Y-%m'), count(*) FROM t GROUP BY 2 UNION ALL SELECT 'kpi', 'price', CAST(coalesce(sum(price), 0) AS BIGINT) FROM t""")
def a72_partner_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One party: carriers, delivery split, months, volume."""
    t = trips(spark, sf_dir, lanes=False).where("customer = 11")
    count = lambda df, c: df.groupBy(c.alias("name")).agg(_n().alias("n"))
    split = F.when(F.col("on_time") == 1, "met").when(F.col("on_time") == 0, "late").otherwise("unknown")
    return _parts(
        ("carrier", count(t.where("carrier is not null"), F.col("carrier")), "name"),
        ("split", count(t, split), "name"),
        ("month", count(t, F.date_format("booked", "yyyy-MM")), "name"),
        ("kpi", t.agg(F.coalesce(F.sum("price"), F.lit(0)).alias("n")).withColumn("name", F.lit("price")), "name"),
    )


@query(f"""WITH {PLACED_SQL}, s AS (SELECT CAST(floor(lat * 10) AS BIGINT) * 10000 + CAST(floor(lon * 10) AS BIGINT) AS cluster, vehicle, us FROM placed WHERE NOT moving),
a AS (SELECT cluster, count(*) AS stops, count(DISTINCT vehicle) AS vehicles, count(*) FILTER (WHERE (us // {HOUR}) % 24 < 6) AS nights FROM s GROUP BY cluster)
SELECT cluster, stops, vehicles, CAST(floor(1e6 * (0.5 * ln(1 + vehicles) / ln(101.0) + 0.5 * (nights + 5 * 0.25) / (stops + 5.0)) + 0.5) AS BIGINT) AS score_ppm FROM a""")
def g18_cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by how many vehicles stop there, squashed, and by their share of nights, drawn to a prior."""
    cluster = F.floor(F.col("lat") * 10) * 10_000 + F.floor(F.col("lon") * 10)
    a = placed(spark, sf_dir).where("not moving").groupBy(cluster.alias("cluster")).agg(
        _n().alias("stops"), F.countDistinct("vehicle").alias("vehicles"), F.count_if(F.floor(F.col("us") / HOUR) % 24 < 6).alias("nights")
    )
    squashed, nights = F.log1p("vehicles") / F.log(F.lit(101.0)), R.smoothed_rate(F.col("nights"), F.col("stops"), F.lit(0.25), 5.0)
    return a.select("cluster", "stops", "vehicles", F.floor(1e6 * (0.5 * squashed + 0.5 * nights) + 0.5).alias("score_ppm"))


@query(f"""WITH {PINGS_SQL}, d AS (SELECT vehicle, us // {DAY} AS day, count(*) FILTER (WHERE moving) AS drives, count(*) FILTER (WHERE (us // {HOUR}) % 24 < 6) AS nights FROM pings GROUP BY ALL)
SELECT vehicle, day, sum(drives) OVER w AS week_drives, sum(nights) OVER w AS week_nights, sum(drives) OVER w + 2 * sum(nights) OVER w >= 6 AS tired FROM d
WINDOW w AS (PARTITION BY vehicle ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)""", whole=("week_drives", "week_nights"))
def n09_fatigue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load and nights of the last seven days, and the label by rule."""
    days = pings(spark, sf_dir).groupBy("vehicle", F.floor(F.col("us") / DAY).alias("day")).agg(F.count_if("moving").alias("drives"), F.count_if(F.floor(F.col("us") / HOUR) % 24 < 6).alias("nights"))
    w = Window.partitionBy("vehicle").orderBy("day").rangeBetween(-6, 0)
    df = days.select("vehicle", "day", F.sum("drives").over(w).alias("week_drives"), F.sum("nights").over(w).alias("week_nights"))
    return df.withColumn("tired", F.col("week_drives") + 2 * F.col("week_nights") >= 6)


@query(f"""WITH {TRIPS_SQL} SELECT trip, CAST(floor(qty * 10 / (4.0::DOUBLE - 0.01::DOUBLE * least(days, 100) + CASE WHEN status = 'F' THEN 0.5 ELSE 0.0 END) * 1000 + 0.5) AS BIGINT) AS litres_milli FROM trips""")
def f29_fuel_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuel from distance and a mileage that load and age lower, without noise."""
    mileage = F.lit(4.0) - F.lit(0.01) * F.least("days", F.lit(100)) + F.when(F.col("status") == "F", 0.5).otherwise(0.0)
    return trips(spark, sf_dir, lanes=False).select("trip", F.floor(F.col("qty") * 10 / mileage * 1000 + 0.5).alias("litres_milli"))


@query(f"""WITH {STAYS_SQL}, o AS (SELECT vehicle, seq, site, part, enter, leave, row_number() OVER (PARTITION BY vehicle ORDER BY enter, seq, part, site) AS pos, count(*) OVER (PARTITION BY vehicle) AS n FROM stays)
SELECT vehicle, seq, part, site, CASE WHEN pos = 1 THEN 'loading' WHEN pos = n THEN 'unloading' ELSE 'transit' END AS phase, lead(enter) OVER (PARTITION BY vehicle ORDER BY pos) - leave AS gap_us FROM o""")
def i09_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a trip by its places in order, with the time to the next place (negative if they overlap)."""
    w = Window.partitionBy("vehicle").orderBy("enter", "seq", "part", "site")
    df = stays(spark, sf_dir).withColumn("pos", F.row_number().over(w)).withColumn("gap_us", F.lead("enter").over(w) - F.col("leave"))
    phase = F.when(F.col("pos") == 1, "loading").when(F.lead("pos").over(w).isNull(), "unloading").otherwise("transit")
    return df.select("vehicle", "seq", "part", "site", phase.alias("phase"), "gap_us")


@query(f"""WITH {PINGS_SQL}, r AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {_W} THEN 1 ELSE 0 END AS new FROM pings), g AS (SELECT *, sum(new) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM r),
b AS (SELECT vehicle, grp, any_value(event_type) AS kind, count(*) AS n FROM g GROUP BY vehicle, grp) SELECT vehicle, string_agg(kind || '*' || CAST(n AS VARCHAR), ' ' ORDER BY grp) AS bar FROM b GROUP BY vehicle""")
def i11_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of a trail as one line: what a list shows, so it is as long as the trail changes often."""
    runs = S.islands(pings(spark, sf_dir), "vehicle", _ORDER, S.changed("event_type", "vehicle", _ORDER)).groupBy("vehicle", "grp").agg(F.first("event_type").alias("kind"), _n().alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("grp", F.concat_ws("*", "kind", F.col("n").cast("string")).alias("x"))))
    return runs.groupBy("vehicle").agg(F.array_join(F.transform(parts, lambda p: p["x"]), " ").alias("bar"))
