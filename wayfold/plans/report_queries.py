"""Composite reads and model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import rates as R
from wayfold.operators import clusters
from wayfold.operators import intervals as I
from wayfold.operators import sequences as S
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, STAYS_SQL, TRIPS_SQL, pings, placed, read, stays, trips

_ORDER = ["us", "event_id"]
_W = "OVER (PARTITION BY vehicle ORDER BY us, event_id)"
_ROWS = "OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DAY = 24 * HOUR


def _n() -> Column:
    return F.count(F.lit(1))


@query(f"""WITH {TRIPS_SQL}, e AS (SELECT carrier, CAST(year(booked) AS BIGINT) AS y, count(*) AS n, sum(price) AS price FROM trips WHERE carrier IN (1, 2, 3) GROUP BY ALL)
SELECT y, coalesce(max(n) FILTER (WHERE carrier = 1), 0) AS n1, coalesce(max(n) FILTER (WHERE carrier = 2), 0) AS n2, coalesce(max(n) FILTER (WHERE carrier = 3), 0) AS n3 FROM e GROUP BY y""")
def c08_compare_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of picked carriers side by side, gaps filled with zero."""
    e = trips(spark, sf_dir).where("carrier in (1, 2, 3)").groupBy(F.year("booked").cast("long").alias("y")).pivot("carrier", [1, 2, 3]).agg(_n())
    return e.select("y", *[F.coalesce(str(c), F.lit(0)).alias(f"n{c}") for c in (1, 2, 3)])


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT carrier, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS otd FROM trips WHERE carrier IS NOT NULL GROUP BY carrier), f AS (SELECT 100.0 * sum(on_time) / nullif(count(on_time), 0) AS fleet FROM trips WHERE carrier IS NOT NULL)
SELECT carrier, CASE WHEN otd IS NULL THEN 'none' WHEN otd > fleet * 1.05 THEN 'better' WHEN otd < fleet * 0.95 THEN 'worse' ELSE 'level' END AS tone FROM g, f""")
def c10_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each carrier against the fleet, within five percent counting as level."""
    df = trips(spark, sf_dir).where("carrier is not null")
    g, f = df.groupBy("carrier").agg(R.known_rate(F.col("on_time")).alias("otd")), df.agg(R.known_rate(F.col("on_time")).alias("fleet"))
    tone = F.when(F.col("otd").isNull(), "none").when(F.col("otd") > F.col("fleet") * 1.05, "better").when(F.col("otd") < F.col("fleet") * 0.95, "worse").otherwise("level")
    return g.join(F.broadcast(f), how="cross").select("carrier", tone.alias("tone"))


@query(f"""WITH {TRIPS_SQL} SELECT array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses, array_to_string(list_sort(list(DISTINCT priority)), ',') AS priorities, min(booked) AS first_day, max(booked) AS last_day FROM trips""")
def c12_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option lists and bounds of a dashboard."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return trips(spark, sf_dir).agg(listed("status").alias("statuses"), listed("priority").alias("priorities"), F.min("booked").alias("first_day"), F.max("booked").alias("last_day"))


@query(f"""WITH {PINGS_SQL}, w AS (SELECT event_type AS name, min(us) AS first_us, max(us) AS last_us, count(*) AS fixes, count(DISTINCT vehicle) AS vehicles, CAST(sum(k) AS DOUBLE) / count(*) AS mean_k FROM pings GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY fixes DESC, name) AS place FROM w""")
def c04_waypoint_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = pings(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), _n().alias("fixes"), F.countDistinct("vehicle").alias("vehicles"), (F.sum("k").cast("double") / _n()).alias("mean_k"))
    return w.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fixes"), "name")).cast("long"))


@query(f"""WITH {PINGS_SQL}, t AS (SELECT k AS wp, count(*) AS n FROM pings GROUP BY ALL ORDER BY n DESC, wp LIMIT 5)
SELECT p.k AS wp, (us // {HOUR}) % 24 AS hour, count(*) AS n FROM pings p JOIN t ON t.wp = p.k GROUP BY ALL""")
def c05_waypoint_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest five waypoints by hour: a top-k report."""
    df = pings(spark, sf_dir).withColumn("wp", F.col("k"))
    top = df.groupBy("wp").agg(_n().alias("n")).orderBy(F.desc("n"), "wp").limit(5).select("wp")
    return df.join(F.broadcast(top), "wp").groupBy("wp", (F.floor(F.col("us") / HOUR) % 24).alias("hour")).agg(_n().alias("n"))


@query(f"""WITH {TRIPS_SQL} SELECT customer, count(*) AS trips, max(booked) AS latest, sum(qty) AS qty FROM trips GROUP BY customer HAVING count(*) >= 2 ORDER BY trips DESC, customer LIMIT 20 OFFSET 20""", whole=("qty",))
def c15_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a list with a minimum, in a total order."""
    g = trips(spark, sf_dir).groupBy("customer").agg(_n().alias("trips"), F.max("booked").alias("latest"), F.sum("qty").alias("qty")).where("trips >= 2")
    return g.orderBy(F.desc("trips"), "customer").offset(20).limit(20)


@query(f"""WITH {TRIPS_SQL}, r AS (SELECT origin, dest, count(*) AS n, median(days) AS days, count(DISTINCT carrier) AS carriers FROM trips WHERE dest IS NOT NULL GROUP BY ALL) SELECT origin, dest, n, days, carriers, rank() OVER (PARTITION BY origin ORDER BY n DESC) AS rnk FROM r""")
def c17_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = trips(spark, sf_dir).where("dest is not null").groupBy("origin", "dest").agg(_n().alias("n"), F.median("days").alias("days"), F.countDistinct("carrier").alias("carriers"))
    return r.withColumn("rnk", F.rank().over(Window.partitionBy("origin").orderBy(F.desc("n"))).cast("long"))


@query(f"""WITH {PINGS_SQL}, x AS (SELECT vehicle % 20 AS carrier, count(DISTINCT vehicle * 100 + us // {DAY} % 100) AS vehicle_days FROM pings GROUP BY ALL), f AS (SELECT *, speed > 4000 AS fast, lag(speed > 4000) {_W} AS was FROM pings),
e AS (SELECT vehicle % 20 AS carrier, count(*) FILTER (WHERE fast AND NOT coalesce(was, false)) AS episodes, max(speed) AS peak FROM f GROUP BY ALL) SELECT x.carrier, vehicle_days, episodes, peak, 100.0 * episodes / vehicle_days AS per_100 FROM x LEFT JOIN e ON e.carrier = x.carrier""")
def a56_carrier_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes against exposure per carrier."""
    df = pings(spark, sf_dir).withColumn("carrier", F.col("vehicle") % 20)
    x = df.groupBy("carrier").agg(F.countDistinct(F.col("vehicle") * 100 + F.floor(F.col("us") / DAY) % 100).alias("vehicle_days"))
    fast = F.col("speed") > 4000
    starts = fast & ~F.coalesce(F.lag(fast).over(S.series("vehicle", *_ORDER)), F.lit(False))
    e = df.withColumn("starts", starts).groupBy("carrier").agg(F.count_if("starts").alias("episodes"), F.max("speed").alias("peak"))
    return x.join(e, "carrier", "left").withColumn("per_100", 100.0 * F.col("episodes") / F.col("vehicle_days"))


@query(f"""WITH {PINGS_SQL}, d AS (SELECT us // {DAY} AS day, count(*) AS fixes, count(DISTINCT vehicle) AS vehicles, count(*) FILTER (WHERE speed > 5000) AS alerts FROM pings GROUP BY ALL)
SELECT day, fixes, vehicles, alerts, CAST(sum(fixes) OVER w AS DOUBLE) / count(*) OVER w AS usual FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def a69_day_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's figures with the average of the seven days before; windows see one row per day."""
    d = pings(spark, sf_dir).groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(_n().alias("fixes"), F.countDistinct("vehicle").alias("vehicles"), F.count_if(F.col("speed") > 5000).alias("alerts"))
    w = Window.orderBy("day").rowsBetween(-7, -1)
    return d.withColumn("usual", F.sum("fixes").over(w).cast("double") / F.nullif(_n().over(w), F.lit(0)))


@query(f"""WITH {TRIPS_SQL} SELECT n_regionkey AS region, count(DISTINCT s_suppkey) AS sites, count(trip) AS trips, coalesce(sum(price), 0) AS price FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN trips ON carrier = s_suppkey GROUP BY ALL""", whole=("price",))
def a70_region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and activity per region; both sides are aggregated before they meet."""
    per_site = trips(spark, sf_dir).where("carrier is not null").groupBy(F.col("carrier").alias("s_suppkey")).agg(_n().alias("trips"), F.sum("price").alias("price"))
    sites = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(per_site, "s_suppkey", "left")
    return sites.groupBy(F.col("n_regionkey").alias("region")).agg(_n().alias("sites"), F.coalesce(F.sum("trips"), F.lit(0)).alias("trips"), F.coalesce(F.sum("price"), F.lit(0)).alias("price"))


@query(f"""WITH {PINGS_SQL} SELECT vehicle, count(*) FILTER (WHERE speed > 4000) AS fast, arg_min(event_type, (us, event_id)) FILTER (WHERE speed > 4000) AS first_fast FROM pings GROUP BY vehicle""")
def a78_vehicle_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = F.col("speed") > 4000
    return pings(spark, sf_dir).groupBy("vehicle").agg(F.count_if(fast).alias("fast"), F.min_by(F.when(fast, F.col("event_type")), F.when(fast, F.struct("us", "event_id"))).alias("first_fast"))


@query(f"""WITH {PINGS_SQL} SELECT vehicle, count(*) AS n, sum(speed) AS t, n * sum(speed * speed) - sum(speed) * sum(speed) AS n2_variance FROM pings GROUP BY vehicle""", whole=("t", "n2_variance"))
def a41_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n squared times the population variance, in whole numbers."""
    return pings(spark, sf_dir).groupBy("vehicle").agg(_n().alias("n"), F.sum("speed").alias("t"), (_n() * F.sum(F.col("speed") * F.col("speed")) - F.sum("speed") * F.sum("speed")).alias("n2_variance"))


@query(f"""WITH {PINGS_SQL}, s AS (SELECT *, CASE WHEN moving THEN 0 ELSE 1 END AS still FROM pings)
SELECT event_id, vehicle, run FROM (SELECT event_id, vehicle, still, sum(CASE WHEN still = 1 AND coalesce(b, 0) = 0 THEN 1 ELSE 0 END) {_ROWS} AS run FROM (SELECT *, lag(still) {_W} AS b FROM s) y) z WHERE still = 1""", whole=("run",))
def w32_standstill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of standstill runs."""
    df = pings(spark, sf_dir)
    starts = ~F.col("moving") & F.coalesce(F.lag("moving").over(S.series("vehicle", *_ORDER)), F.lit(True))
    return S.islands(df, "vehicle", _ORDER, starts, "run").where("not moving").select("event_id", "vehicle", "run")


@query(f"""WITH {STAYS_SQL}, m0 AS (SELECT *, max(leave) OVER (PARTITION BY site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stays), m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0),
u AS (SELECT site, min(enter) AS a, max(leave) AS b FROM m1 GROUP BY site, grp) SELECT s.site, s.vehicle, s.seq, s.part, s.leave - s.enter AS own_us FROM stays s WHERE s.flag = 'R' AND EXISTS (SELECT 1 FROM u WHERE u.site = s.site AND u.a < s.enter AND s.enter < u.b)""")
def w39_shared_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines whose start lies inside the union of their site's stays: time that is not exclusive."""
    df = stays(spark, sf_dir)
    u = I.merged(df.select("site", "enter", "leave"), ["site"]).select("site", F.col("enter").alias("a"), F.col("leave").alias("b"))
    r = df.where("flag = 'R'").withColumn("e1", F.col("enter") + 1)
    hit = I.overlap_join(r, u, "site", 30 * DAY, "enter", "e1", "a", "b").where(F.col("a") < F.col("enter"))
    return hit.select("site", "vehicle", "seq", "part", (F.col("leave") - F.col("enter")).alias("own_us"))


@query(f"""WITH {STAYS_SQL} SELECT vehicle, CAST(sum(leave - enter) FILTER (WHERE flag = 'A') AS BIGINT) AS loading_us, CAST(sum(leave - enter) FILTER (WHERE flag = 'N') AS BIGINT) AS transit_us, CAST(sum(leave - enter) FILTER (WHERE flag = 'R') AS BIGINT) AS unloading_us, max(leave) - min(enter) AS span_us FROM stays GROUP BY vehicle""")
def i10_phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda f: F.sum(F.when(F.col("flag") == f, F.col("leave") - F.col("enter")))
    return stays(spark, sf_dir).groupBy("vehicle").agg(part("A").alias("loading_us"), part("N").alias("transit_us"), part("R").alias("unloading_us"), (F.max("leave") - F.min("enter")).alias("span_us"))


@query(f"""WITH {STAYS_SQL}, a AS (SELECT site, vehicle, enter, leave, part FROM stays WHERE status = 'F'), b AS (SELECT site, vehicle, enter, leave, part FROM stays WHERE status = 'O')
SELECT a.site, a.part AS a_part, a.vehicle AS a_vehicle, count(b.part) AS overlaps FROM a LEFT JOIN b ON b.site = a.site AND b.enter < a.leave AND a.enter < b.leave GROUP BY a.site, a.part, a.vehicle, a.enter, a.leave""")
def j16_run_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each visit of one run, how many visits of another overlap it; visits without any count zero."""
    df = stays(spark, sf_dir)
    a = df.where("status = 'F'").select("site", F.col("part").alias("a_part"), F.col("vehicle").alias("a_vehicle"), F.col("enter").alias("a1"), F.col("leave").alias("a2"))
    b = df.where("status = 'O'").select("site", F.col("enter").alias("b1"), F.col("leave").alias("b2"))
    keys = ["site", "a_part", "a_vehicle", "a1", "a2"]
    groups, hits = a.select(keys).distinct(), I.overlap_join(a, b, "site", 30 * DAY, "a1", "a2", "b1", "b2").groupBy(*keys).agg(_n().alias("n"))
    return groups.join(hits, keys, "left").select("site", "a_part", "a_vehicle", F.coalesce("n", F.lit(0)).alias("overlaps"))


@query("""WITH a AS (SELECT p_partkey, upper(trim(p_brand)) AS key, CASE WHEN p_size > 25 THEN 'load' ELSE 'unload' END AS role FROM part), f AS (SELECT upper(trim(p_brand)) AS key, CASE WHEN p_size > 45 THEN 'load' ELSE 'any' END AS role, min(p_partkey) AS fence FROM part WHERE p_size > 40 GROUP BY ALL)
SELECT a.p_partkey, coalesce(x.fence, y.fence) AS fence FROM a LEFT JOIN f x ON x.key = a.key AND x.role = a.role LEFT JOIN f y ON y.key = a.key AND y.role = 'any'""")
def j24_fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fence of a name in its role, else in any."""
    part = read(spark, sf_dir, "part").withColumn("key", F.upper(F.trim("p_brand")))
    a = part.withColumn("role", F.when(F.col("p_size") > 25, "load").otherwise("unload"))
    f = part.where("p_size > 40").groupBy("key", F.when(F.col("p_size") > 45, "load").otherwise("any").alias("role")).agg(F.min("p_partkey").alias("fence"))
    anyhow = f.where("role = 'any'").select("key", F.col("fence").alias("any_fence"))
    return a.join(f, ["key", "role"], "left").join(anyhow, "key", "left").select("p_partkey", F.coalesce("fence", "any_fence").alias("fence"))


@query(f"""WITH {PINGS_SQL}, m AS (SELECT vehicle, median(speed) AS mid FROM pings GROUP BY vehicle), d AS (SELECT p.*, abs(speed - mid) AS off, mid FROM pings p JOIN m ON m.vehicle = p.vehicle), a AS (SELECT vehicle, median(off) AS mad FROM d GROUP BY vehicle)
SELECT event_id, d.vehicle, speed FROM d JOIN a ON a.vehicle = d.vehicle WHERE mad > 0 AND off > 4 * mad""")
def n03_robust_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies by the median absolute deviation, which outliers do not shift."""
    df = pings(spark, sf_dir)
    d = df.join(df.groupBy("vehicle").agg(F.median("speed").alias("mid")), "vehicle").withColumn("off", F.abs(F.col("speed") - F.col("mid")))
    return d.join(d.groupBy("vehicle").agg(F.median("off").alias("mad")), "vehicle").where("mad > 0 and off > 4 * mad").select("event_id", "vehicle", "speed")


@query(f"""WITH {PINGS_SQL}, g AS (SELECT vehicle, count(*) AS n, count(*) FILTER (WHERE speed > 5000) AS fast, count(*) FILTER (WHERE (us // {HOUR}) % 24 < 5) AS night FROM pings GROUP BY vehicle), s AS (SELECT vehicle, 100 - 200.0 * fast / n - 50.0 * night / n AS score FROM g)
SELECT vehicle, greatest(0, score) AS score, CASE WHEN score >= 80 THEN 'low' WHEN score >= 60 THEN 'medium' ELSE 'high' END AS risk FROM s""")
def n04_driver_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 100 - 200.0 * F.count_if(F.col("speed") > 5000) / _n() - 50.0 * F.count_if(F.floor(F.col("us") / HOUR) % 24 < 5) / _n()
    s = pings(spark, sf_dir).groupBy("vehicle").agg(score.alias("score"))
    return s.select("vehicle", F.greatest(F.lit(0.0), F.col("score")).alias("score"), F.when(F.col("score") >= 80, "low").when(F.col("score") >= 60, "medium").otherwise("high").alias("risk"))


@query(f"""WITH {TRIPS_SQL}, e AS (SELECT origin, dest, carrier, count(*) AS n, coalesce(sum(on_time), 0) AS hits FROM trips WHERE carrier IS NOT NULL GROUP BY ALL), o AS (SELECT origin, carrier, sum(n) AS o_n FROM e GROUP BY ALL)
SELECT origin, dest, carrier, rn FROM (SELECT e.origin, e.dest, e.carrier, row_number() OVER (PARTITION BY e.origin, e.dest ORDER BY 10 * e.n + 5 * e.hits + o_n DESC, e.carrier) AS rn FROM e JOIN o ON o.origin = e.origin AND o.carrier = e.carrier) x WHERE rn <= 3""")
def n08_recommended_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three carriers per lane by their record on it, then near it."""
    e = trips(spark, sf_dir).where("carrier is not null and origin is not null").groupBy("origin", "dest", "carrier").agg(_n().alias("n"), F.coalesce(F.sum("on_time"), F.lit(0)).alias("hits"))
    scored = e.withColumn("o_n", F.sum("n").over(Window.partitionBy("origin", "carrier"))).withColumn("score", 10 * F.col("n") + 5 * F.col("hits") + F.col("o_n"))
    rn = F.row_number().over(Window.partitionBy("origin", "dest").orderBy(F.desc("score"), "carrier")).cast("long")
    return scored.withColumn("rn", rn).where("rn <= 3").select("origin", "dest", "carrier", "rn")


@query(f"""WITH {PINGS_SQL}, s AS (SELECT event_id, k AS y, lag(k) {_W} AS a, lag(k, 2) {_W} AS b, lag(k, 3) {_W} AS c FROM pings), p AS (SELECT y, (4 * a + 2 * b + c) AS p7 FROM s WHERE c IS NOT NULL)
SELECT count(*) AS n, sum(abs(7 * y - p7)) AS abs7, sum((7 * y - p7) * (7 * y - p7)) AS sq49 FROM p""", whole=("abs7", "sq49"))
def n12_forecast_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a decayed-mean predictor over all rows, in sevenths: absolute and squared."""
    w = S.series("vehicle", *_ORDER)
    s = pings(spark, sf_dir).select(F.col("k").alias("y"), *[F.lag("k", i).over(w).alias(f"b{i}") for i in (1, 2, 3)]).where("b3 is not null")
    off = 7 * F.col("y") - (4 * F.col("b1") + 2 * F.col("b2") + F.col("b3"))
    return s.agg(_n().alias("n"), F.sum(F.abs(off)).alias("abs7"), F.sum(off * off).alias("sq49"))


@query(f"""WITH {PINGS_SQL}, d AS (SELECT vehicle % 10 AS lane, us // {DAY} AS day, count(*) AS y FROM pings GROUP BY ALL), m AS (SELECT lane, count(*) AS n, sum(day) AS sx, sum(y) AS sy, sum(day * y) AS sxy, sum(day * day) AS sxx, max(day) AS last FROM d GROUP BY lane)
SELECT lane, CAST(floor(1000 * ((sy - CAST(n * sxy - sx * sy AS DOUBLE) / (n * sxx - sx * sx) * sx) / n + CAST(n * sxy - sx * sy AS DOUBLE) / (n * sxx - sx * sx) * (last + 1)) + 0.5) AS BIGINT) AS next_milli FROM m WHERE n >= 14""")
def n05_demand_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tomorrow's demand per lane by least squares over its days, from sums that add up across partitions."""
    d = pings(spark, sf_dir).groupBy((F.col("vehicle") % 10).alias("lane"), F.floor(F.col("us") / DAY).alias("day")).agg(_n().alias("y"))
    x, y = F.col("day"), F.col("y")
    m = d.groupBy("lane").agg(_n().alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.max(x).alias("last")).where("n >= 14")
    slope = F.expr("cast(n * sxy - sx * sy as double) / (n * sxx - sx * sx)")
    return m.select("lane", F.floor(1000 * ((F.col("sy") - slope * F.col("sx")) / F.col("n") + slope * (F.col("last") + 1)) + 0.5).alias("next_milli"))


@query(f"""WITH RECURSIVE {PLACED_SQL}, p AS (SELECT event_id AS id, CAST(floor(lat * 1000) AS BIGINT) AS y, CAST(floor(lon * 1000) AS BIGINT) AS x FROM placed),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 40 AND abs(a.y - b.y) <= 40 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600),
core AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 4), e AS (SELECT n.a, n.b FROM n JOIN core c ON c.a = n.a JOIN core d ON d.a = n.b),
r AS (SELECT a AS id, a AS label FROM core UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id),
l AS (SELECT id, min(label) AS label FROM r GROUP BY id) SELECT p.id, coalesce(l.label, (SELECT min(m.label) FROM n JOIN l m ON m.id = n.b WHERE n.a = p.id)) AS cluster FROM p LEFT JOIN l ON l.id = p.id""")
def g17_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters: grid neighbours, core points, components of cores; a border point joins the lowest cluster near it."""
    p = placed(spark, sf_dir).select(F.col("event_id").alias("id"), F.floor(F.col("lat") * 1000).alias("y"), F.floor(F.col("lon") * 1000).alias("x"))
    return clusters.dbscan(p, 40, 4)
