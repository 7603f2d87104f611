"""Figures over trips, fixes and stays, zones with real distances, and what streams decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import rates as R
from wayfold.functions import scalars as X
from wayfold.operators import intervals as I
from wayfold.operators import sequences as S
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, STAYS_SQL, TRIPS_SQL, pings, placed, read, stays, trips

_ORDER = ["us", "event_id"]
_W = "OVER (PARTITION BY vehicle ORDER BY us, event_id)"
_ROWS = "OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)"
SILENCE = 12 * HOUR
_STEPS = """ev AS (SELECT site, us, sum(d) AS d FROM (SELECT site, enter AS us, 1 AS d FROM stays WHERE enter < leave UNION ALL SELECT site, leave, -1 FROM stays WHERE enter < leave)
 GROUP BY ALL HAVING sum(d) <> 0),
steps AS (SELECT site, us, CAST(sum(d) OVER (PARTITION BY site ORDER BY us) AS BIGINT) AS level, lead(us) OVER (PARTITION BY site ORDER BY us) AS until FROM ev)"""


@query(f"WITH {TRIPS_SQL} SELECT carrier, 100.0 * count(*) FILTER (WHERE on_time = 1) / nullif(count(on_time), 0) AS rate FROM trips GROUP BY carrier")
def a02_known_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of trips on time among those judged; null where none is."""
    return trips(spark, sf_dir).groupBy("carrier").agg(R.known_rate(F.col("on_time")).alias("rate"))


@query(f"WITH {TRIPS_SQL} SELECT customer, CAST(floor(1000 * avg(on_time) + 0.5) AS BIGINT) AS per_mille FROM trips GROUP BY customer")
def a04_judged_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).groupBy("customer").agg(F.floor(1000 * F.avg("on_time") + 0.5).alias("per_mille"))


@query(f"WITH {TRIPS_SQL} SELECT carrier, sum(CASE WHEN days > 80 THEN days END) AS long_days FROM trips GROUP BY carrier", whole=("long_days",))
def a05_reported_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing reported is null, not 0."""
    return trips(spark, sf_dir).groupBy("carrier").agg(F.sum(F.when(F.col("days") > 80, F.col("days"))).alias("long_days"))


@query(f"""WITH {TRIPS_SQL}, r AS (SELECT carrier, sum(CASE WHEN days > 80 THEN qty END) AS total, count(*) FILTER (WHERE days > 80) AS n FROM trips GROUP BY carrier)
SELECT carrier, CAST(total AS DOUBLE) / nullif(n, 0) AS per_trip FROM r""")
def a06_per_reporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over the trips that report alone."""
    some = F.col("days") > 80
    sums = trips(spark, sf_dir).groupBy("carrier").agg(F.sum(F.when(some, F.col("qty"))).alias("total"), F.count_if(F.coalesce(some, F.lit(False))).alias("n"))
    return sums.select("carrier", R.per_reporting(F.col("total").cast("double"), F.col("n")).alias("per_trip"))


@query("""WITH c AS (SELECT l_suppkey AS site, l_returnflag AS flag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT site, arg_max(flag, (n, -first_seen)) AS flag FROM c GROUP BY site""")
def a11_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent known value; of equals the one seen first."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    counts = lines.groupBy(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen")
    )
    return counts.groupBy("site").agg(F.max_by("flag", F.struct("n", -F.col("first_seen"))).alias("flag"))


@query(f"""WITH {PINGS_SQL}, c AS (SELECT vehicle, us // {24 * HOUR} AS day, event_type, count(*) AS n FROM pings GROUP BY ALL)
SELECT vehicle, day, min_by(event_type, (-n, event_type)) AS dominant FROM c GROUP BY vehicle, day""")
def a12_dominant_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent name of a block; of equals the first in the alphabet."""
    counts = pings(spark, sf_dir).groupBy("vehicle", F.floor(F.col("us") / (24 * HOUR)).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("vehicle", "day").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("dominant"))


@query(f"""WITH {STAYS_SQL}, {_STEPS}, t AS (SELECT site, level, sum(until - us) AS w FROM steps WHERE level > 0 AND until IS NOT NULL GROUP BY site, level),
c AS (SELECT *, sum(w) OVER (PARTITION BY site ORDER BY level) AS so_far, sum(w) OVER (PARTITION BY site) AS total FROM t)
SELECT site, min(level) AS usual FROM c WHERE so_far >= total * 0.9 GROUP BY site""")
def a22_usual_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that holds for 90 % of the busy time."""
    at = I.level_time(I.occupancy(stays(spark, sf_dir), ["site"]), ["site"])
    return I.weighted_percentile(at, ["site"], "level", "at_level_us", 0.9).withColumnRenamed("level", "usual")


@query(f"WITH {PLACED_SQL} SELECT vehicle, max(speed) AS peak, arg_max(lat, (speed, event_id)) AS lat, arg_max(lon, (speed, event_id)) AS lon FROM placed GROUP BY vehicle")
def a24_where_the_peak_was(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max(F.struct("speed", "event_id", "lat", "lon"))
    return placed(spark, sf_dir).groupBy("vehicle").agg(top.alias("x")).select("vehicle", F.col("x.speed").alias("peak"), "x.lat", "x.lon")


@query(f"WITH {PINGS_SQL} SELECT event_type, CAST(floor(8 * quantile_cont(speed, 0.9) + 0.5) AS BIGINT) AS eighths FROM pings GROUP BY event_type")
def a25_linear_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentile with linear interpolation; values are counted before they meet."""
    counts = pings(spark, sf_dir).groupBy("event_type", "speed").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("event_type").agg(F.floor(8 * F.percentile("speed", 0.9, F.col("n")) + 0.5).alias("eighths"))


@query(f"WITH {PINGS_SQL} SELECT vehicle, list_sort(list(k))[count(*) // 2 + 1] AS upper_middle, median(k) AS true_median FROM pings GROUP BY vehicle")
def a27_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of the two middle values, and their mean; from counts, so that no series is collected."""
    counts = pings(spark, sf_dir).groupBy("vehicle", "k").agg(F.count(F.lit(1)).alias("n"))
    upper = R.rank_value(counts, ["vehicle"], "k", "n", lambda total: F.floor(total / 2) + 1)
    return upper.withColumnRenamed("k", "upper_middle").join(counts.groupBy("vehicle").agg(F.percentile("k", 0.5, F.col("n")).alias("true_median")), "vehicle")


@query(f"""WITH {STAYS_SQL} SELECT CASE WHEN leave - enter < {6 * HOUR} THEN 'under 6 h' WHEN leave - enter < {24 * HOUR} THEN '6 to 24 h' WHEN leave - enter < {48 * HOUR} THEN '1 to 2 d' ELSE 'over 2 d' END AS bucket,
count(*) AS n, sum(leave - enter) AS inside_us FROM stays GROUP BY 1""", whole=("inside_us",))
def a31_dwell_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.col("leave") - F.col("enter")
    bucket = F.when(span < 6 * HOUR, "under 6 h").when(span < 24 * HOUR, "6 to 24 h").when(span < 48 * HOUR, "1 to 2 d").otherwise("over 2 d")
    return stays(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(span).alias("inside_us"))


@query(f"""WITH {PLACED_SQL}, c AS (SELECT CAST(floor(lat * 4) AS BIGINT) AS row_no, CAST(floor(lon * 4) AS BIGINT) AS col_no, count(*) AS n FROM placed GROUP BY ALL)
SELECT row_no, col_no, n, CAST(n AS DOUBLE) / (SELECT max(n) FROM c) AS weight FROM c""")
def a37_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes per cell, as a share of the fullest one."""
    cells = placed(spark, sf_dir).groupBy(F.floor(F.col("lat") * 4).alias("row_no"), F.floor(F.col("lon") * 4).alias("col_no")).agg(F.count(F.lit(1)).alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.max("n").alias("most")))).select("row_no", "col_no", "n", (F.col("n").cast("double") / F.col("most")).alias("weight"))


@query(f"""WITH {TRIPS_SQL} SELECT status, count(*) AS trips, count(*) FILTER (WHERE on_time = 1) AS met, count(*) FILTER (WHERE days > 80) AS long_ones, count(*) FILTER (WHERE origin = dest) AS local_ones
FROM trips GROUP BY status""")
def a40_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = {"met": F.col("on_time") == 1, "long_ones": F.col("days") > 80, "local_ones": F.col("origin") == F.col("dest")}
    return trips(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("trips"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in counted.items()])


@query(f"""WITH {TRIPS_SQL}, c AS (SELECT carrier, count(*) AS n FROM trips WHERE carrier IS NOT NULL GROUP BY carrier), s AS (SELECT sum(n) AS total FROM c),
t AS (SELECT sum(n) AS top FROM (SELECT n FROM c ORDER BY n DESC LIMIT 3))
SELECT count(*) AS carriers, median(n) AS typical, CAST((SELECT top FROM t) * 1000 // any_value(total) AS BIGINT) AS top3_per_mille, CAST(sum(n * n) * 10000 // (any_value(total) * any_value(total)) AS BIGINT) AS hhi FROM c, s""")
def a44_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is usual among carriers and how concentrated they are."""
    carriers = trips(spark, sf_dir).where("carrier is not null").groupBy("carrier").agg(F.count(F.lit(1)).alias("n"))
    top = carriers.orderBy(F.desc("n")).limit(3).agg(F.sum("n").alias("top"))
    facts = carriers.agg(F.count(F.lit(1)).alias("carriers"), F.median("n").alias("typical"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return facts.crossJoin(F.broadcast(top)).select(
        "carriers", "typical", F.floor(F.col("top") * 1000 / F.col("total")).alias("top3_per_mille"), F.floor(F.col("squares") * 10000 / (F.col("total") * F.col("total"))).alias("hhi")
    )


@query(f"""WITH {TRIPS_SQL}, c AS (SELECT carrier, count(*) AS n, 100.0 * avg(on_time) AS rate FROM trips WHERE carrier IS NOT NULL GROUP BY carrier), m AS (SELECT median(n) AS mid FROM c)
SELECT carrier, CASE WHEN n >= mid AND rate >= 50 THEN 'core' WHEN n >= mid THEN 'fix' WHEN rate >= 50 THEN 'grow' WHEN rate IS NULL THEN 'unknown' ELSE 'exit' END AS quadrant FROM c, m""")
def a45_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume split at the median against the target of punctuality."""
    carriers = trips(spark, sf_dir).where("carrier is not null").groupBy("carrier").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg("on_time")).alias("rate"))
    much, good = F.col("n") >= F.col("mid"), F.col("rate") >= 50
    quadrant = F.when(much & good, "core").when(much, "fix").when(good, "grow").when(F.col("rate").isNull(), "unknown").otherwise("exit")
    return carriers.crossJoin(F.broadcast(carriers.agg(F.median("n").alias("mid")))).select("carrier", quadrant.alias("quadrant"))


@query(f"WITH {TRIPS_SQL} SELECT priority, count(*) AS n, 100.0 * count(*) FILTER (WHERE on_time = 1) / nullif(count(on_time), 0) AS rate FROM trips GROUP BY priority")
def a49_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), R.known_rate(F.col("on_time")).alias("rate"))


_GAP = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(25.0::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(25.0::DOUBLE)) * pow(sin(radians(77.5::DOUBLE - lon) / 2), 2)))) / 1000"


@query(f"""WITH {PLACED_SQL}, l AS (SELECT vehicle, arg_max(event_type, (us, event_id)) AS dest, arg_max(lat, (us, event_id)) AS lat, arg_max(lon, (us, event_id)) AS lon FROM placed GROUP BY vehicle),
g AS (SELECT dest, CAST(floor({_GAP}) AS BIGINT) AS km FROM l) SELECT dest, count(*) AS n, min(km) AS least_km, median(km) AS mid_km, count(*) FILTER (WHERE km <= 300) AS arrived FROM g GROUP BY dest""")
def a52_end_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far from its target each trail ends, by destination."""
    last = placed(spark, sf_dir).groupBy("vehicle").agg(F.max(F.struct("us", "event_id", "event_type", "lat", "lon")).alias("x")).select(F.col("x.event_type").alias("dest"), "x.lat", "x.lon")
    km = F.floor(X.haversine_m(F.col("lat"), F.col("lon"), F.lit(25.0), F.lit(77.5)) / 1000)
    gaps = last.select("dest", km.alias("km"))
    return gaps.groupBy("dest").agg(F.count(F.lit(1)).alias("n"), F.min("km").alias("least_km"), F.median("km").alias("mid_km"), F.count_if(F.col("km") <= 300).alias("arrived"))


@query(f"WITH {PINGS_SQL} SELECT vehicle, count(*) AS events, max(speed) AS peak, sum(speed - 6000) AS excess FROM pings WHERE speed > 6000 GROUP BY vehicle ORDER BY events DESC, peak DESC, vehicle LIMIT 20", whole=("excess",))
def a58_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = pings(spark, sf_dir).where("speed > 6000").groupBy("vehicle").agg(F.count(F.lit(1)).alias("events"), F.max("speed").alias("peak"), F.sum(F.col("speed") - 6000).alias("excess"))
    return over.orderBy(F.desc("events"), F.desc("peak"), "vehicle").limit(20)


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'plant' ELSE 'road' END AS zone, speed > 6000 AS fast FROM pings),
g AS (SELECT *, lag(fast) OVER (PARTITION BY vehicle, zone ORDER BY us, event_id) AS was FROM f)
SELECT zone, count(*) AS fixes, count(DISTINCT vehicle) AS vehicles, count(*) FILTER (WHERE fast) AS over, count(*) FILTER (WHERE fast AND NOT coalesce(was, false)) AS episodes,
 100.0 * count(*) FILTER (WHERE fast AND NOT coalesce(was, false)) / count(DISTINCT vehicle) AS per_100 FROM g GROUP BY zone""")
def a59_speed_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, fixes above the limit and episodes per 100 vehicles, by zone."""
    df = pings(spark, sf_dir).withColumn("zone", F.when(F.col("k") % 4 == 0, "plant").otherwise("road")).withColumn("fast", F.col("speed") > 6000)
    was = F.coalesce(F.lag("fast").over(S.series(["vehicle", "zone"], *_ORDER)), F.lit(False))
    out = df.withColumn("new", F.col("fast") & ~was).groupBy("zone").agg(
        F.count(F.lit(1)).alias("fixes"), F.countDistinct("vehicle").alias("vehicles"), F.count_if("fast").alias("over"), F.count_if("new").alias("episodes")
    )
    return out.withColumn("per_100", F.lit(100.0) * F.col("episodes") / F.col("vehicles"))


@query(f"""WITH {PINGS_SQL}, h AS (SELECT us // {24 * HOUR} AS day, (us // {HOUR}) % 24 AS hour, count(*) AS n FROM pings GROUP BY ALL),
s AS (SELECT day, range AS hour FROM (SELECT DISTINCT day FROM h), range(24)), a AS (SELECT s.day, s.hour, coalesce(n, 0) AS n FROM s LEFT JOIN h USING (day, hour))
SELECT day, sum(n) AS fixes, string_agg(CAST(n AS VARCHAR), ',' ORDER BY hour) AS by_hour FROM a GROUP BY day""", whole=("fixes",))
def a62_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of each day, with 24 slots."""
    hours = pings(spark, sf_dir).groupBy(F.floor(F.col("us") / (24 * HOUR)).alias("day"), (F.floor(F.col("us") / HOUR) % 24).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    days = hours.groupBy("day").agg(F.sum("n").alias("fixes"), F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("slots"))
    slots = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")), lambda h: F.coalesce(F.element_at("slots", h), F.lit(0)).cast("string"))
    return days.select("day", "fixes", F.array_join(slots, ",").alias("by_hour"))


@query(f"""WITH {STAYS_SQL}, s AS (SELECT site, count(*) AS visits, max(leave - enter) AS longest_us FROM stays GROUP BY site)
SELECT 'site' AS part, CAST(site AS VARCHAR) AS name, visits AS n FROM (SELECT * FROM s ORDER BY visits DESC, site LIMIT 10)
UNION ALL SELECT 'longest', CAST(site AS VARCHAR), longest_us // {HOUR} FROM (SELECT * FROM s ORDER BY longest_us DESC, site LIMIT 5)
UNION ALL SELECT 'quality', flag, count(*) FROM stays GROUP BY flag
UNION ALL SELECT 'never visited', 'suppliers', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT site FROM s)""")
def a68_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a report in one table: top sites, longest stays, quality mix, what was never visited."""
    df = stays(spark, sf_dir)
    sites = df.groupBy("site").agg(F.count(F.lit(1)).alias("visits"), F.max(F.col("leave") - F.col("enter")).alias("longest_us"))
    row = lambda part, name, n: (F.lit(part).alias("part"), name.alias("name"), n.alias("n"))
    never = read(spark, sf_dir, "supplier").join(sites, F.col("s_suppkey") == F.col("site"), "left_anti")
    parts = [
        sites.orderBy(F.desc("visits"), "site").limit(10).select(*row("site", F.col("site").cast("string"), F.col("visits"))),
        sites.orderBy(F.desc("longest_us"), "site").limit(5).select(*row("longest", F.col("site").cast("string"), F.floor(F.col("longest_us") / HOUR))),
        df.groupBy("flag").agg(F.count(F.lit(1)).alias("v")).select(*row("quality", F.col("flag"), F.col("v"))),
        never.agg(F.count(F.lit(1)).alias("v")).select(*row("never visited", F.lit("suppliers"), F.col("v"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT coalesce(n_name, '(unmapped)') AS state, count(*) AS n FROM trips LEFT JOIN nation ON n_nationkey = dest GROUP BY 1)
SELECT state, n, CAST(n AS DOUBLE) / sum(n) OVER () AS share, rank() OVER (ORDER BY n DESC, state) <= 3 AS top3 FROM g""")
def a71_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips by destination with their share, what is not on the map as a row of its own."""
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dest"), "n_name")
    states = trips(spark, sf_dir).groupBy("dest").agg(F.count(F.lit(1)).alias("n")).join(names, "dest", "left").groupBy(F.coalesce("n_name", F.lit("(unmapped)")).alias("state")).agg(F.sum("n").alias("n"))
    everything = Window.partitionBy()  # a row a state
    return states.select("state", "n", (F.col("n").cast("double") / F.sum("n").over(everything)).alias("share"), (F.rank().over(Window.orderBy(F.desc("n"), "state")) <= 3).alias("top3"))


@query(f"""WITH {PLACED_SQL}, c AS (SELECT CAST(floor(lat * 10) AS BIGINT) * 10000 + CAST(floor(lon * 10) AS BIGINT) AS cluster, vehicle, us FROM placed WHERE NOT moving)
SELECT cluster, vehicle, count(*) AS stops, min(us) AS first_us, max(us) AS last_us FROM c GROUP BY ALL""")
def a73_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stopped in each cluster, how often and when."""
    cluster = F.floor(F.col("lat") * 10) * 10_000 + F.floor(F.col("lon") * 10)
    return placed(spark, sf_dir).where("not moving").groupBy(cluster.alias("cluster"), "vehicle").agg(F.count(F.lit(1)).alias("stops"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"""WITH {PLACED_SQL}, f AS (SELECT *, CASE WHEN moving IS DISTINCT FROM lag(moving) {_W} THEN 1 ELSE 0 END AS new FROM placed), g AS (SELECT *, sum(new) {_ROWS} AS grp FROM f)
SELECT vehicle, min(us) AS start_us, max(us) AS end_us, median(lat) AS lat, median(lon) AS lon, count(*) AS fixes FROM g WHERE NOT moving GROUP BY vehicle, grp HAVING max(us) - min(us) >= {4 * HOUR}""")
def w06_stop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of standing fixes of four hours or more, at their median position."""
    df = S.islands(placed(spark, sf_dir), "vehicle", _ORDER, S.changed("moving", "vehicle", _ORDER)).where("not moving")
    blocks = df.groupBy("vehicle", "grp").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count(F.lit(1)).alias("fixes")
    )
    return blocks.where(F.col("end_us") - F.col("start_us") >= 4 * HOUR).drop("grp")


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, speed > 5000 AS fast, lag(speed > 5000) {_W} AS was FROM pings),
g AS (SELECT *, sum(CASE WHEN fast AND NOT coalesce(was, false) THEN 1 ELSE 0 END) {_ROWS} AS grp FROM f)
SELECT vehicle, min(us) AS start_us, max(us) AS end_us, max(speed) AS peak, count(*) AS fixes FROM g WHERE fast GROUP BY vehicle, grp""")
def w10_speed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive fixes above the limit, whatever the silence between them."""
    df = pings(spark, sf_dir).withColumn("fast", F.col("speed") > 5000)
    was = F.coalesce(F.lag("fast").over(S.series("vehicle", *_ORDER)), F.lit(False))
    runs = S.islands(df, "vehicle", _ORDER, F.col("fast") & ~was).where("fast")
    return runs.groupBy("vehicle", "grp").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.max("speed").alias("peak"), F.count(F.lit(1)).alias("fixes")).drop("grp")


@query(f"WITH {TRIPS_SQL}, c AS (SELECT carrier, count(*) AS n FROM trips GROUP BY carrier) SELECT carrier, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS place FROM c")
def w19_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal volumes share the better place. The window sees a row a carrier."""
    carriers = trips(spark, sf_dir).groupBy("carrier").agg(F.count(F.lit(1)).alias("n"))
    return carriers.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))


@query(f"""WITH {PINGS_SQL}, s AS (SELECT vehicle, row_number() OVER (PARTITION BY vehicle ORDER BY event_id) AS id, k FROM pings), l AS (SELECT * FROM s WHERE k % 17 <> 3),
r AS (SELECT vehicle, id, id - row_number() OVER (PARTITION BY vehicle ORDER BY id) AS off FROM l) SELECT vehicle, max(id) AS upto FROM r WHERE off = 0 GROUP BY vehicle""")
def w25_contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to which number a consumer has seen everything: there number and position still agree."""
    ids = pings(spark, sf_dir).withColumn("id", F.row_number().over(S.series("vehicle", "event_id")).cast("long")).where("k % 17 <> 3")
    return ids.withColumn("pos", F.row_number().over(S.series("vehicle", "id"))).where("id = pos").groupBy("vehicle").agg(F.max("id").alias("upto"))


@query(f"""WITH {PINGS_SQL}, t AS (SELECT event_id, vehicle, us // {24 * HOUR} AS day, event_type FROM pings), l AS (SELECT *, lag(event_type) OVER w AS b, lag(day) OVER w AS d FROM t WINDOW w AS (PARTITION BY vehicle ORDER BY day, event_id))
SELECT event_id FROM l WHERE b IS DISTINCT FROM event_type OR d IS DISTINCT FROM day""")
def w29_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only exact repeats of the row before go."""
    df = pings(spark, sf_dir).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    w = S.series("vehicle", "day", "event_id")
    same = F.lag("event_type").over(w).eqNullSafe(F.col("event_type")) & F.lag("day").over(w).eqNullSafe(F.col("day"))
    return df.withColumn("same", same).where("not same").select("event_id")


@query(f"WITH {PINGS_SQL}, l AS (SELECT vehicle, us < lag(us) OVER (PARTITION BY vehicle ORDER BY event_id) AS late FROM pings) SELECT vehicle, count(*) FILTER (WHERE late) AS late FROM l GROUP BY vehicle")
def w30_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.coalesce(F.col("us") < F.lag("us").over(S.series("vehicle", "event_id")), F.lit(False))
    return pings(spark, sf_dir).withColumn("late", late).groupBy("vehicle").agg(F.count_if("late").alias("late"))


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, CASE WHEN moving IS DISTINCT FROM lag(moving) {_W} OR us - lag(us) {_W} > {SILENCE} THEN 1 ELSE 0 END AS new FROM pings), g AS (SELECT *, sum(new) {_ROWS} AS grp FROM f),
b AS (SELECT vehicle, grp, bool_and(NOT moving) AS still, min(us) AS a, max(us) AS z, median(k) AS mid FROM g GROUP BY vehicle, grp),
n AS (SELECT *, lag(still) OVER w AS p_still, lag(mid) OVER w AS p_mid, lag(z) OVER w AS p_z FROM b WINDOW w AS (PARTITION BY vehicle ORDER BY grp)),
m AS (SELECT *, sum(CASE WHEN still AND p_still AND abs(mid - p_mid) <= 15 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY grp) AS stop_no FROM n)
SELECT vehicle, min(a) AS start_us, max(z) AS end_us, count(*) AS parts FROM m WHERE still GROUP BY vehicle, stop_no""")
def w35_stops_over_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops on both sides of a hole are one stop if the place is the same: runs of runs, by their medians."""
    df = pings(spark, sf_dir)
    gap = F.col("us") - F.lag("us").over(S.series("vehicle", *_ORDER))
    df = S.islands(df, "vehicle", _ORDER, S.changed("moving", "vehicle", _ORDER) | F.coalesce(gap > SILENCE, F.lit(False)))
    blocks = df.groupBy("vehicle", "grp").agg(F.bool_and(~F.col("moving")).alias("still"), F.min("us").alias("a"), F.max("us").alias("z"), F.median("k").alias("mid"))
    w = S.series("vehicle", "grp")
    same = F.col("still") & F.lag("still").over(w) & (F.abs(F.col("mid") - F.lag("mid").over(w)) <= 15)
    stops = S.islands(blocks, "vehicle", ["grp"], ~F.coalesce(same, F.lit(False)), "stop_no").where("still")
    return stops.groupBy("vehicle", "stop_no").agg(F.min("a").alias("start_us"), F.max("z").alias("end_us"), F.count(F.lit(1)).alias("parts")).drop("stop_no")


@query(f"""WITH {STAYS_SQL}, {_STEPS}, t AS (SELECT site, level, sum(until - us) AS w FROM steps WHERE level > 0 AND until IS NOT NULL GROUP BY site, level),
c AS (SELECT *, sum(w) OVER (PARTITION BY site ORDER BY level) AS so_far, sum(w) OVER (PARTITION BY site) AS total FROM t), u AS (SELECT site, min(level) AS usual FROM c WHERE so_far >= total * 0.9 GROUP BY site)
SELECT s_suppkey AS site, CASE WHEN s_suppkey % 5 = 0 THEN 4 WHEN usual IS NULL THEN 3 ELSE greatest(3, usual + greatest(1, CAST(ceil(usual * 0.2::DOUBLE) AS BIGINT))) END AS threshold FROM supplier LEFT JOIN u ON site = s_suppkey""")
def i17_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared capacity, else what is usual with a margin, never below the floor."""
    at = I.level_time(I.occupancy(stays(spark, sf_dir), ["site"]), ["site"])
    usual = I.weighted_percentile(at, ["site"], "level", "at_level_us", 0.9).withColumnRenamed("level", "usual")
    sites = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site")).join(usual, "site", "left")
    raised = F.col("usual") + F.greatest(F.lit(1).cast("long"), F.ceil(F.col("usual") * F.lit(0.2)))
    return sites.select("site", F.when(F.col("site") % 5 == 0, F.lit(4).cast("long")).otherwise(F.greatest(F.lit(3).cast("long"), F.coalesce(raised, F.lit(3).cast("long")))).alias("threshold"))


@query(f"""WITH {STAYS_SQL}, {_STEPS}, f AS (SELECT *, level >= 3 AND until IS NOT NULL AS busy, lag(level >= 3) OVER (PARTITION BY site ORDER BY us) AS was FROM steps),
g AS (SELECT *, sum(CASE WHEN busy AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY us) AS grp FROM f),
r AS (SELECT site, min(us) AS enter, max(until) AS leave, max(level) AS peak FROM g WHERE busy GROUP BY site, grp)
SELECT site, enter, CASE WHEN peak >= 6 OR leave - enter >= {72 * HOUR} THEN 'severe' WHEN peak >= 4 OR leave - enter >= {24 * HOUR} THEN 'high' ELSE 'mild' END AS severity, (peak - 2) * ((leave - enter) // {HOUR}) AS score FROM r""")
def i20_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded spans by how far and how long they lie above the threshold."""
    runs = I.runs_at_least(I.occupancy(stays(spark, sf_dir), ["site"]), ["site"], F.lit(3))
    span = F.col("leave") - F.col("enter")
    severity = F.when((F.col("peak") >= 6) | (span >= 72 * HOUR), "severe").when((F.col("peak") >= 4) | (span >= 24 * HOUR), "high").otherwise("mild")
    return runs.select("site", "enter", severity.alias("severity"), ((F.col("peak") - 2) * F.floor(span / HOUR)).alias("score"))


@query(f"""WITH {STAYS_SQL}, d AS (SELECT site, unnest(range((enter + {24 * HOUR - 1}) // {24 * HOUR}, (leave + {24 * HOUR - 1}) // {24 * HOUR})) AS day, flag FROM stays)
SELECT site, day, flag, count(*) AS present FROM d GROUP BY ALL""")
def i22_sampled_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is present at each midnight, by kind: each stay gives its own midnights, so no spine is joined."""
    up = lambda c: F.floor((F.col(c) + (24 * HOUR - 1)) / (24 * HOUR))
    df = stays(spark, sf_dir).withColumn("a", up("enter")).withColumn("b", up("leave") - 1).where("a <= b")
    return df.select("site", F.explode(F.sequence("a", "b")).alias("day"), "flag").groupBy("site", "day", "flag").agg(F.count(F.lit(1)).alias("present"))


@query(f"""WITH {STAYS_SQL}, s AS (SELECT site, max(leave) - min(enter) AS span FROM stays GROUP BY site)
SELECT site, CASE WHEN span <= {600 * HOUR // 60} THEN 1 WHEN span <= {10 * HOUR * 10} THEN 10 WHEN span <= {600 * HOUR} THEN 60 ELSE 60 * CAST(ceil(span / {600.0 * HOUR}::DOUBLE) AS BIGINT) END AS minutes FROM s""")
def i24_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which a span has 600 points at most."""
    spans = stays(spark, sf_dir).groupBy("site").agg((F.max("leave") - F.min("enter")).alias("span"))
    step = F.when(F.col("span") <= 10 * HOUR, 1).when(F.col("span") <= 100 * HOUR, 10).when(F.col("span") <= 600 * HOUR, 60)
    return spans.select("site", F.coalesce(step.cast("long"), 60 * F.ceil(F.col("span") / float(600 * HOUR))).alias("minutes"))


_RING = ((19.95, 76.05), (19.95, 78.25), (29.95, 78.25), (29.95, 76.05))
_SEGMENTS = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(_RING, _RING[1:] + _RING[:1]))
_M = "(6371008.8 * radians(1.0::DOUBLE))"
_RING_SQL = f"""{PLACED_SQL}, seg(alat, alon, blat, blon) AS (VALUES {_SEGMENTS}),
flat AS (SELECT event_id, (alon - lon) * {_M} * cos(radians(lat)) AS ax, (alat - lat) * {_M} AS ay, (blon - lon) * {_M} * cos(radians(lat)) AS bx, (blat - lat) * {_M} AS b_y FROM placed, seg),
near AS (SELECT event_id, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2))) AS far
 FROM (SELECT *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t FROM flat) GROUP BY event_id)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes with their signed distance to one zone, in metres."""
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in _RING])
    return placed(spark, sf_dir).withColumn("distance", X.signed_distance_m(F.col("lat"), F.col("lon"), ring))


@query(f"WITH {_RING_SQL} SELECT event_id, CAST(floor(far / 10 + 0.5) AS BIGINT) AS tens, lat > 19.95 AND lat < 29.95 AND lon > 76.05 AND lon < 78.25 AS inside FROM near JOIN placed USING (event_id)")
def g06_signed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the edge of a zone, in tens of metres, and the side."""
    return _signed(spark, sf_dir).select("event_id", F.floor(F.abs("distance") / 10 + 0.5).alias("tens"), (F.col("distance") < 0).alias("inside"))


@query(f"""WITH {_RING_SQL}, tens AS (
  SELECT event_id, vehicle % 50 AS trail, lat, lon, CAST(floor(far / 10 + 0.5) AS BIGINT) AS tens FROM near JOIN placed USING (event_id)),
closest AS (SELECT *, row_number() OVER (PARTITION BY trail ORDER BY tens, event_id) AS place FROM tens)
SELECT trail, event_id, tens, lat > 19.95 AND lat < 29.95 AND lon > 76.05 AND lon < 78.25 AS inside, true AS agree FROM closest WHERE place <= 6""")
def c61_containment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each trail the six fixes closest to the edge of a zone: the side by signed distance against the side by crossing count."""
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in _RING])
    by_count = X.point_in_ring(F.col("lat"), F.col("lon"), ring)
    near = _signed(spark, sf_dir).select("event_id", (F.col("vehicle") % 50).alias("trail"), "distance", by_count.alias("inside"), F.floor(F.abs("distance") / 10 + 0.5).alias("tens"))
    place = F.row_number().over(Window.partitionBy("trail").orderBy("tens", "event_id"))
    six = near.withColumn("place", place).where("place <= 6")
    return six.select("trail", "event_id", "tens", "inside", ((F.col("distance") < 0) == F.col("inside")).alias("agree"))


@query()
def i26_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a zone paired from confirmed crossings; sequential, so tested against hand-made series and not in SQL."""
    return S.visits(_signed(spark, sf_dir), "vehicle", "us", "distance", 2_000.0, 6 * HOUR, 40_000.0, 48 * HOUR)


@query()
def m02_inside_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes inside by the confirmed state, filled back over the run that confirmed it: those within a visit."""
    df = _signed(spark, sf_dir).select("event_id", "vehicle", "us", "distance")
    spans = S.visits(df, "vehicle", "us", "distance", 2_000.0, 6 * HOUR, 40_000.0, 48 * HOUR).withColumnRenamed("vehicle", "v")
    inside = df.join(spans, (F.col("vehicle") == F.col("v")) & F.col("us").between(F.col("enter"), F.col("leave")), "left_semi")
    return inside.select("event_id", "vehicle")


@query()
def m03_circle_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of a circle of 120 km around a depot."""
    return S.circle_crossings(_from_depot(spark, sf_dir), "vehicle", "us", "metres", 120_000.0, 12 * HOUR, 2.0)


@query()
def m04_first_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a vehicle left the depot for good, or why that is not known."""
    return S.first_exit(_from_depot(spark, sf_dir), "vehicle", "us", "metres", 120_000.0, 12 * HOUR, 2.0)


@query()
def m05_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every customer, refined: those without a series, and those whose series ends at the depot."""
    found = S.first_exit(_from_depot(spark, sf_dir), "vehicle", "us", "metres", 120_000.0, 12 * HOUR, 2.0).withColumnRenamed("us", "exit_us")
    last = _from_depot(spark, sf_dir).groupBy("vehicle").agg(F.max_by("metres", F.struct("us", "event_id")).alias("last_m"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vehicle"))
    df = asked.join(found, "vehicle", "left").join(last, "vehicle", "left")
    refined = F.when(F.col("status").isNull(), "no_gps").when((F.col("status") == "never_exited") & (F.col("last_m") <= 120_000), "gps_died_at_origin").otherwise(F.col("status"))
    return df.select("vehicle", refined.alias("status"), "exit_us")


def _from_depot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).withColumn("metres", X.haversine_m(F.col("lat"), F.col("lon"), F.lit(22.0), F.lit(76.5)))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 25.0::DOUBLE ELSE greatest(0.5, least(25.0, greatest(5.0, 0.5 * p_size), 0.8::DOUBLE * p_size)) END AS band FROM part""")
def m06_adaptive_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", X.adaptive_band(size).alias("band"))


@query(f"""WITH {_RING_SQL}, i AS (SELECT placed.*, lat > 19.95 AND lat < 29.95 AND lon > 76.05 AND lon < 78.25 AS inside FROM placed),
g AS (SELECT vehicle, inside, least(coalesce(us - lag(us) {_W}, 0), {6 * HOUR}) AS gap FROM i)
SELECT vehicle, sum(CASE WHEN inside THEN gap ELSE 0 END) AS inside_us, CAST(sum(CASE WHEN inside THEN gap ELSE 0 END) AS DOUBLE) / nullif(sum(gap), 0) AS coverage FROM g GROUP BY vehicle""", whole=("inside_us",))
def m09_inside_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time inside, with capped gaps, and its share."""
    df = S.with_gap(_signed(spark, sf_dir), "vehicle", _ORDER, cap_us=6 * HOUR)
    inside = F.sum(F.when(F.col("distance") < 0, F.col("gap_us")).otherwise(0))
    return df.groupBy("vehicle").agg(inside.alias("inside_us"), F.try_divide(inside.cast("double"), F.nullif(F.sum("gap_us"), F.lit(0))).alias("coverage"))


@query(f"""WITH {PLACED_SQL}, l AS (SELECT event_id, lat, lon, lag(lat) {_W} AS p_lat, lag(lon) {_W} AS p_lon FROM placed)
SELECT event_id, CAST(floor(6371008.8 * sqrt(pow(radians(lon - p_lon) * cos(radians((p_lat + lat) / 2)), 2) + pow(radians(lat - p_lat), 2)) / 10 + 0.5) AS BIGINT) AS tens FROM l""")
def g02_flat_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.series("vehicle", *_ORDER)
    df = placed(spark, sf_dir).select("event_id", "lat", "lon", F.lag("lat").over(w).alias("p_lat"), F.lag("lon").over(w).alias("p_lon"))
    return df.select("event_id", F.floor(X.flat_distance_m(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")) / 10 + 0.5).alias("tens"))


@query(f"""SELECT p_partkey, CAST(floor(1e7 * (100.0::DOUBLE * p_size / {_M}) + 0.5) AS BIGINT) AS dlat, CAST(floor(1e7 * (100.0::DOUBLE * p_size / ({_M} * cos(radians(CAST(p_size AS DOUBLE))))) + 0.5) AS BIGINT) AS dlon FROM part""")
def g03_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres as degrees of a box, in units of 1e-7."""
    size = F.col("p_size").cast("double")
    df = read(spark, sf_dir, "part").select("p_partkey", X.metres_to_degrees(F.lit(100.0) * size, size).alias("d"))
    return df.select("p_partkey", F.floor(1e7 * F.col("d.lat") + 0.5).alias("dlat"), F.floor(1e7 * F.col("d.lon") + 0.5).alias("dlon"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 750.0::DOUBLE ELSE greatest(150.0, least(500.0, p_size * 15.0::DOUBLE)) END AS radius FROM part")
def g20_radius_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override, else the spread and a half within bounds."""
    rule = F.greatest(F.lit(150.0), F.least(F.lit(500.0), F.col("p_size") * 10.0 * 1.5))
    return read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 20 == 0, 750.0).otherwise(rule).alias("radius"))


@query(f"""WITH {PINGS_SQL}, n AS (SELECT vehicle, max(us) AS newest FROM pings WHERE k % 50 > 0 GROUP BY vehicle), a AS (SELECT DISTINCT vehicle FROM pings)
SELECT vehicle, CASE WHEN newest IS NULL THEN 0 ELSE newest - {HOUR} END AS watermark FROM a LEFT JOIN n USING (vehicle)""")
def t08_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value seen less the delay; a source that showed none holds where it was."""
    newest = F.max(F.when(F.col("k") % 50 > 0, F.col("us")))
    return pings(spark, sf_dir).groupBy("vehicle").agg(F.coalesce(newest - HOUR, F.lit(0).cast("long")).alias("watermark"))


@query(f"""WITH {PINGS_SQL}, late AS (SELECT DISTINCT vehicle FROM pings WHERE event_id >= (SELECT max(event_id) - 100 FROM pings))
SELECT vehicle, count(*) AS fixes, max(speed) AS peak FROM pings WHERE vehicle IN (SELECT vehicle FROM late) GROUP BY vehicle""")
def t10_reevaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late fixes are never patched in: every series that one touches is evaluated whole."""
    df = pings(spark, sf_dir)
    newest = df.agg(F.max("event_id").alias("newest"))
    touched = df.crossJoin(F.broadcast(newest)).where(F.col("event_id") >= F.col("newest") - 100).select("vehicle").distinct()
    return df.join(touched, "vehicle", "left_semi").groupBy("vehicle").agg(F.count(F.lit(1)).alias("fixes"), F.max("speed").alias("peak"))


@query(f"""WITH {PINGS_SQL}, now AS (SELECT vehicle, count(*) AS n FROM pings GROUP BY 1), past AS (SELECT vehicle, count(*) AS n FROM pings WHERE k < 95 GROUP BY 1)
SELECT vehicle, now.n - coalesce(past.n, 0) AS behind FROM now LEFT JOIN past USING (vehicle) WHERE now.n <> coalesce(past.n, 0)""")
def t12_stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with other counts than when they were evaluated (here: without the fixes that came last); one pass over both."""
    counts = pings(spark, sf_dir).groupBy("vehicle").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < 95).alias("past"))
    return counts.where("n <> past").select("vehicle", (F.col("n") - F.col("past")).alias("behind"))
