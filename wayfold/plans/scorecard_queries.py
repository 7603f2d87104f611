"""Scorecards, drills, detail reads and model features over the same views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import rates as R
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


@query(f"""WITH {TRIPS_SQL}, f AS (SELECT carrier, status, sum(price) AS price, count(*) AS n FROM trips GROUP BY ALL) SELECT carrier, sum(n) AS trips, sum(price) AS price, count(*) AS parts FROM f GROUP BY carrier""", whole=("trips", "price"))
def a15_reaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup rolled up once more: only additive measures may be."""
    part = trips(spark, sf_dir).groupBy("carrier", "status").agg(F.sum("price").alias("price"), _n().alias("n"))
    return part.groupBy("carrier").agg(F.sum("n").alias("trips"), F.sum("price").alias("price"), _n().alias("parts"))


_SUMMARIES = {"customer": "customer", "carrier": "carrier", "lane": "CAST(origin AS VARCHAR) || '>' || CAST(dest AS VARCHAR)", "month": "strftime(booked, '%Y-%m')"}


@query(f"WITH {TRIPS_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({v} AS VARCHAR) AS key, count(*) AS trips, sum(qty) AS qty, count(on_time) AS known FROM trips GROUP BY ALL" for k, v in _SUMMARIES.items()), whole=("qty",))
def a16_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameterised summary by several keys."""
    df = trips(spark, sf_dir)
    lane = F.when(F.col("origin").isNotNull() & F.col("dest").isNotNull(), F.concat(F.col("origin").cast("string"), F.lit(">"), F.col("dest").cast("string")))
    keys = {"customer": F.col("customer").cast("string"), "carrier": F.col("carrier").cast("string"), "lane": lane, "month": F.date_format("booked", "yyyy-MM")}
    # One pass: each trip is laid out once per kind and grouped together.
    wide = df.select("qty", "on_time", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])).alias("x"))
    return wide.groupBy("x.kind", "x.key").agg(_n().alias("trips"), F.sum("qty").alias("qty"), F.count("on_time").alias("known")).select("kind", "key", "trips", "qty", "known")


@query(f"""WITH {PINGS_SQL}, g AS (SELECT vehicle % 10 AS lane, speed // 100 AS kmph, least(coalesce(us - lag(us) {_W}, 0), {6 * HOUR}) AS gap FROM pings), h AS (SELECT lane, kmph, CAST(sum(gap) AS BIGINT) AS w FROM g GROUP BY ALL), l AS (SELECT unnest([20, 40, 60]) AS lim)
SELECT lane, CAST(lim AS BIGINT) AS lim, CAST(sum(w) FILTER (WHERE kmph > lim) AS BIGINT) AS over_us, CAST(sum(w) AS BIGINT) AS total_us FROM h, l GROUP BY ALL""")
def a20_rebinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any threshold from one histogram."""
    df = S.with_gap(pings(spark, sf_dir), "vehicle", _ORDER, cap_us=6 * HOUR)
    hist = df.groupBy((F.col("vehicle") % 10).alias("lane"), F.floor(F.col("speed") / 100).alias("kmph")).agg(F.sum("gap_us").alias("w"))
    limits = hist.withColumn("lim", F.explode(F.array(*[F.lit(x).cast("long") for x in (20, 40, 60)])))
    return limits.groupBy("lane", "lim").agg(F.sum(F.when(F.col("kmph") > F.col("lim"), F.col("w"))).alias("over_us"), F.sum("w").alias("total_us"))


@query(f"WITH {PINGS_SQL} SELECT vehicle, CAST(sum(speed * k) AS DOUBLE) / nullif(sum(k), 0) AS mean, arg_max(event_type || ':' || CAST(k AS VARCHAR), (speed, event_id)) AS at_peak FROM pings GROUP BY vehicle")
def a23_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean, and what held at the peak."""
    peak = F.max_by(F.concat("event_type", F.lit(":"), F.col("k").cast("string")), F.struct("speed", "event_id"))
    return pings(spark, sf_dir).groupBy("vehicle").agg((F.sum(F.col("speed") * F.col("k")).cast("double") / F.nullif(F.sum("k"), F.lit(0))).alias("mean"), peak.alias("at_peak"))


@query(f"""WITH {PINGS_SQL}, p AS (SELECT quantile_disc(speed, 0.95) AS cap FROM pings) SELECT CASE WHEN speed > cap THEN -1 ELSE speed // greatest(1, cap // 20) END AS bin, count(*) AS n FROM pings, p GROUP BY ALL""")
def a30_capped_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram up to the 95th percentile, and one bucket (-1) for what lies beyond."""
    df = pings(spark, sf_dir)
    ranked = df.groupBy("speed").agg(_n().alias("n"))
    order = Window.orderBy("speed")  # over distinct speeds only
    so_far = ranked.withColumns({"so_far": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy())})
    cap = so_far.where(F.col("so_far") >= F.ceil(F.col("total") * F.lit(0.95))).agg(F.min("speed").alias("cap"))
    bin_ = F.when(F.col("speed") > F.col("cap"), -1).otherwise(F.floor(F.col("speed") / F.greatest(F.lit(1), F.floor(F.col("cap") / 20))))
    return df.join(F.broadcast(cap), how="cross").groupBy(bin_.alias("bin")).agg(_n().alias("n"))


@query(f"""WITH {PINGS_SQL}, d AS (SELECT speed // 100 AS v, count(*) AS n FROM pings GROUP BY ALL) SELECT v, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS at_most, sum(n) OVER (ORDER BY v) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM d""")
def a32_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution function over bands; the unpartitioned window sees one row per band."""
    d = pings(spark, sf_dir).groupBy(F.floor(F.col("speed") / 100).alias("v")).agg(_n().alias("n"))
    at_most = F.sum("n").over(Window.orderBy("v"))
    return d.select("v", at_most.alias("at_most"), (at_most / F.sum("n").over(Window.partitionBy()).cast("double")).alias("share"))


@query(f"""WITH {TRIPS_SQL}, t AS (SELECT status, count(*) AS n, sum(days) AS x, sum(stops) AS y, sum(days * stops) AS xy, sum(days * days) AS xx, sum(stops * stops) AS yy FROM trips WHERE days IS NOT NULL AND stops IS NOT NULL GROUP BY status)
SELECT status, n, CAST(floor(1e6 * (n * xy - x * y) / sqrt(CAST(n * xx - x * x AS DOUBLE) * CAST(n * yy - y * y AS DOUBLE)) + 0.5) AS BIGINT) AS corr_ppm FROM t WHERE n > 10""")
def a34_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson over complete pairs from whole-number sums, in millionths."""
    x, y = F.col("days"), F.col("stops")
    t = trips(spark, sf_dir).where("days is not null and stops is not null").groupBy("status").agg(_n().alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    # Products of sums pass 64 bits on some millions of trips.
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    apart = lambda a, b, ab: (whole("n") * whole(ab) - whole(a) * whole(b)).cast("double")
    ppm = 1e6 * apart("x", "y", "xy") / F.sqrt(apart("x", "x", "xx") * apart("y", "y", "yy"))
    return t.where("n > 10").select("status", "n", F.floor(ppm + 0.5).alias("corr_ppm"))


@query(f"""WITH {PINGS_SQL}, h AS (SELECT vehicle, (us // {HOUR}) % 24 AS hour, count(*) AS n FROM pings GROUP BY ALL), s AS (SELECT v.vehicle, g.h AS hour FROM (SELECT DISTINCT vehicle FROM pings) v, generate_series(0, 23) AS g(h))
SELECT s.vehicle, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY s.hour) AS profile FROM s LEFT JOIN h ON h.vehicle = s.vehicle AND h.hour = s.hour GROUP BY s.vehicle""")
def a39_hour_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 24-slot profile per vehicle."""
    hour = F.floor(F.col("us") / HOUR) % 24
    return pings(spark, sf_dir).groupBy("vehicle").agg(F.concat_ws(",", *[F.count_if(hour == h).cast("string") for h in range(24)]).alias("profile"))


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT carrier, count(*) AS n, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS otd, median(days) AS days, count(DISTINCT customer) AS customers FROM trips WHERE carrier IS NOT NULL GROUP BY carrier),
p AS (SELECT *, CASE WHEN otd >= 85 THEN 4 WHEN otd >= 80 THEN 3 WHEN otd >= 70 THEN 2 WHEN otd IS NOT NULL THEN 1 END AS a, CASE WHEN days <= 1000 THEN 4 WHEN days <= 1300 THEN 3 WHEN days <= 1500 THEN 2 WHEN days IS NOT NULL THEN 1 END AS b FROM g)
SELECT carrier, CASE WHEN a IS NULL AND b IS NULL THEN 'unrated' WHEN (coalesce(a * 3, 0) + coalesce(b * 2, 0)) / CAST(CASE WHEN a IS NULL THEN 0 ELSE 3 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END AS DOUBLE) >= 3 THEN 'A' WHEN (coalesce(a * 3, 0) + coalesce(b * 2, 0)) / CAST(CASE WHEN a IS NULL THEN 0 ELSE 3 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END AS DOUBLE) >= 2 THEN 'B' ELSE 'C' END AS grade FROM p""")
def a43_banded_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute bands per axis; the weights of unknown axes are spread over the known ones."""
    g = trips(spark, sf_dir).where("carrier is not null").groupBy("carrier").agg(R.known_rate(F.col("on_time")).alias("otd"), F.median("days").alias("days"))
    a = F.when(F.col("otd") >= 85, 4).when(F.col("otd") >= 80, 3).when(F.col("otd") >= 70, 2).when(F.col("otd").isNotNull(), 1)
    b = F.when(F.col("days") <= 1000, 4).when(F.col("days") <= 1300, 3).when(F.col("days") <= 1500, 2).when(F.col("days").isNotNull(), 1)
    weight = F.when(a.isNull(), 0).otherwise(3) + F.when(b.isNull(), 0).otherwise(2)
    points = F.try_divide(F.coalesce(a * 3, F.lit(0)) + F.coalesce(b * 2, F.lit(0)), weight)
    return g.select("carrier", F.when(points.isNull(), "unrated").when(points >= 3, "A").when(points >= 2, "B").otherwise("C").alias("grade"))


@query(f"""WITH {TRIPS_SQL}, l AS (SELECT carrier, origin, dest, count(*) AS n FROM trips WHERE carrier IN (1, 2, 3, 4) AND dest IS NOT NULL GROUP BY ALL), s AS (SELECT origin, dest FROM l GROUP BY ALL HAVING count(DISTINCT carrier) >= 1)
SELECT origin, dest, coalesce(sum(n) FILTER (WHERE carrier = 1), 0) AS c1, coalesce(sum(n) FILTER (WHERE carrier = 2), 0) AS c2, coalesce(sum(n) FILTER (WHERE carrier = 3), 0) AS c3, coalesce(sum(n) FILTER (WHERE carrier = 4), 0) AS c4 FROM l JOIN s USING (origin, dest) GROUP BY ALL""", whole=("c1", "c2", "c3", "c4"))
def a47_shared_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of lanes by picked carriers."""
    l = trips(spark, sf_dir).where("carrier in (1, 2, 3, 4) and dest is not null").groupBy("origin", "dest").pivot("carrier", [1, 2, 3, 4]).agg(_n())
    return l.select("origin", "dest", *[F.coalesce(str(c), F.lit(0)).alias(f"c{c}") for c in (1, 2, 3, 4)])


@query(f"""WITH {PINGS_SQL}, t AS (SELECT vehicle, count(*) AS fixes, count(*) FILTER (WHERE moving) AS moving, max(us) - min(us) AS span FROM pings GROUP BY vehicle),
v AS (SELECT vehicle, CASE WHEN fixes < 5 THEN 'no_gps' WHEN span < {10 * DAY} THEN 'short' WHEN moving * 2 < fixes THEN 'stuck' ELSE 'healthy' END AS verdict FROM t)
SELECT vehicle % 10 AS lane, count(*) FILTER (WHERE verdict = 'healthy') AS healthy, count(*) FILTER (WHERE verdict = 'stuck') AS stuck, count(*) FILTER (WHERE verdict = 'short') AS short, count(*) FILTER (WHERE verdict = 'no_gps') AS no_gps, 100.0 * count(*) FILTER (WHERE verdict = 'healthy') / count(*) AS score FROM v GROUP BY ALL""")
def a50_gps_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict per series, then counts and a score per group."""
    t = pings(spark, sf_dir).groupBy("vehicle").agg(_n().alias("fixes"), F.count_if("moving").alias("moving"), (F.max("us") - F.min("us")).alias("span"))
    verdict = F.when(F.col("fixes") < 5, "no_gps").when(F.col("span") < 10 * DAY, "short").when(F.col("moving") * 2 < F.col("fixes"), "stuck").otherwise("healthy")
    kinds = ["healthy", "stuck", "short", "no_gps"]
    out = t.withColumn("verdict", verdict).groupBy((F.col("vehicle") % 10).alias("lane"))
    return out.agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds], (100.0 * F.count_if(F.col("verdict") == "healthy") / _n()).alias("score"))


@query(f"""WITH {TRIPS_SQL}, b AS (SELECT dest, median(days) AS base FROM trips WHERE days IS NOT NULL GROUP BY dest HAVING count(*) >= 5) SELECT t.dest, count(*) AS near_base, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins FROM trips t JOIN b ON b.dest = t.dest WHERE days >= 0.9 * base GROUP BY t.dest""")
def a51_baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only trips that cover 90 % of their group's median, in groups large enough to have one."""
    df = trips(spark, sf_dir).where("days is not null and dest is not null")
    base = df.groupBy("dest").agg(F.median("days").alias("base"), _n().alias("n")).where("n >= 5").drop("n")
    near = df.join(base, "dest").where(F.col("days") >= F.lit(0.9) * F.col("base"))
    return near.groupBy("dest").agg(_n().alias("near_base"), F.array_join(F.array_sort(F.collect_set("origin")).cast("array<string>"), ",").alias("origins"))


@query(f"""WITH {TRIPS_SQL}, w AS (SELECT carrier, date_sub('minute', started, booked) AS a, date_sub('minute', booked, started) AS b FROM trips WHERE started IS NOT NULL)
SELECT carrier, count(*) AS trips, count(*) FILTER (WHERE b > 0) AS waited, count(*) FILTER (WHERE b <= 0) AS negative, median(b) FILTER (WHERE b > 0) AS median_min, max(b) FILTER (WHERE b > 0) AS worst_min FROM w GROUP BY carrier""")
def a53_detention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting from booking to start; negative spans are counted apart and never averaged in."""
    w = trips(spark, sf_dir).where("started is not null").select("carrier", F.timestamp_diff("MINUTE", "booked", "started").alias("b"))
    late = F.when(F.col("b") > 0, F.col("b"))
    return w.groupBy("carrier").agg(_n().alias("trips"), F.count(late).alias("waited"), F.count_if(F.col("b") <= 0).alias("negative"), F.median(late).alias("median_min"), F.max(late).alias("worst_min"))


@query(f"""WITH {PINGS_SQL}, e AS (SELECT us // {DAY} AS day, count(*) FILTER (WHERE speed > 5000) AS fast, count(DISTINCT vehicle) AS vehicles FROM pings GROUP BY ALL)
SELECT day, fast, vehicles, 100.0 * fast / vehicles AS per_100, fast = max(fast) OVER () AS worst, sum(fast) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS week_before FROM e""", whole=("week_before",))
def a55_safety_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day against exposure, the worst day, and the week before; windows see one row per day."""
    e = pings(spark, sf_dir).groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.count_if(F.col("speed") > 5000).alias("fast"), F.countDistinct("vehicle").alias("vehicles"))
    return e.select("day", "fast", "vehicles", (100.0 * F.col("fast") / F.col("vehicles")).alias("per_100"), (F.col("fast") == F.max("fast").over(Window.partitionBy())).alias("worst"), F.sum("fast").over(Window.orderBy("day").rowsBetween(-7, -1)).alias("week_before"))


@query(f"""WITH {PINGS_SQL}, g AS (SELECT (us // {HOUR}) % 24 AS hour, moving, least(coalesce(lead(us) {_W} - us, 0), {HOUR}) AS w FROM pings), h AS (SELECT hour, CAST(sum(w) FILTER (WHERE moving) AS BIGINT) AS moving_us, CAST(sum(w) FILTER (WHERE NOT moving) AS BIGINT) AS standing_us FROM g GROUP BY hour)
SELECT CAST(s.h AS BIGINT) AS hour, coalesce(moving_us, 0) AS moving_us, coalesce(standing_us, 0) AS standing_us FROM generate_series(0, 23) AS s(h) LEFT JOIN h ON h.hour = s.h""")
def a57_running_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fleet does in each hour of the day."""
    w = F.least(F.coalesce(F.lead("us").over(S.series("vehicle", *_ORDER)) - F.col("us"), F.lit(0)), F.lit(HOUR))
    g = pings(spark, sf_dir).select((F.floor(F.col("us") / HOUR) % 24).alias("hour"), "moving", w.alias("w"))
    h = g.groupBy("hour").agg(F.sum(F.when(F.col("moving"), F.col("w"))).alias("moving_us"), F.sum(F.when(~F.col("moving"), F.col("w"))).alias("standing_us"))
    return spark.range(24).withColumnRenamed("id", "hour").join(h, "hour", "left").na.fill(0)


@query(f"""WITH {STAYS_SQL}, f AS (SELECT s_suppkey AS site FROM supplier), v AS (SELECT site, count(*) AS visits, count(DISTINCT vehicle) AS vehicles, count(*) FILTER (WHERE status = 'O') AS open, median(leave - enter) FILTER (WHERE status = 'F') AS dwell_us, max(leave - enter) FILTER (WHERE status = 'F') AS worst_us FROM stays GROUP BY site)
SELECT f.site, coalesce(visits, 0) AS visits, coalesce(vehicles, 0) AS vehicles, coalesce(open, 0) AS open, dwell_us, worst_us FROM f LEFT JOIN v ON v.site = f.site""")
def a60_site_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and dwell per site, dwell over measured stays only, with sites that nobody visited."""
    closed = F.when(F.col("status") == "F", F.col("leave") - F.col("enter"))
    v = stays(spark, sf_dir).groupBy("site").agg(_n().alias("visits"), F.countDistinct("vehicle").alias("vehicles"), F.count_if(F.col("status") == "O").alias("open"), F.median(closed).alias("dwell_us"), F.max(closed).alias("worst_us"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site")).join(v, "site", "left").na.fill(0, ["visits", "vehicles", "open"])


@query(f"""WITH {PINGS_SQL}, d AS (SELECT DISTINCT vehicle, us // {HOUR} AS hour, event_type FROM pings) SELECT hour // 24 AS day, count(*) AS fixes, count(DISTINCT vehicle) AS vehicles FROM d GROUP BY ALL""")
def a63_distinct_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a fix count once."""
    d = pings(spark, sf_dir).select("vehicle", F.floor(F.col("us") / HOUR).alias("hour"), "event_type").distinct()
    return d.groupBy(F.floor(F.col("hour") / 24).alias("day")).agg(_n().alias("fixes"), F.countDistinct("vehicle").alias("vehicles"))


@query(f"""WITH {STAYS_SQL}, o AS (SELECT part, site, min(vehicle) AS owner FROM stays GROUP BY ALL) SELECT owner, count(*) AS events FROM o GROUP BY owner""")
def a64_event_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event counts for exactly one trip, the lowest."""
    return stays(spark, sf_dir).groupBy("part", "site").agg(F.min("vehicle").alias("owner")).groupBy("owner").agg(_n().alias("events"))


@query(f"""WITH {STAYS_SQL}, o AS (SELECT site, vehicle, max(leave - enter) AS sample FROM stays GROUP BY ALL) SELECT site, count(*) AS samples, median(sample) AS median_us FROM o GROUP BY site""")
def a65_once_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = stays(spark, sf_dir).groupBy("site", "vehicle").agg(F.max(F.col("leave") - F.col("enter")).alias("sample"))
    return o.groupBy("site").agg(_n().alias("samples"), F.median("sample").alias("median_us"))


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT priority AS grp, sum(CASE on_time WHEN 1 THEN qty WHEN 0 THEN -qty END) AS v, count(*) AS n FROM trips GROUP BY ALL), t AS (SELECT sum(abs(v)) AS total, count(*) AS groups FROM g)
SELECT grp, v, n, 100.0 * abs(v) / total AS share, groups FROM g, t ORDER BY abs(v) DESC NULLS LAST, grp LIMIT 12""", whole=("v",))
def a66_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headline by group, the twelve largest in size, with shares and the number of groups: a top-k report."""
    signed = F.when(F.col("on_time") == 1, F.col("qty")).when(F.col("on_time") == 0, -F.col("qty"))
    g = trips(spark, sf_dir).groupBy(F.col("priority").alias("grp")).agg(F.sum(signed).alias("v"), _n().alias("n"))
    t = g.agg(F.sum(F.abs("v")).alias("total"), _n().alias("groups"))
    return g.join(F.broadcast(t), how="cross").select("grp", "v", "n", (100.0 * F.abs("v") / F.col("total")).alias("share"), "groups").orderBy(F.desc_nulls_last(F.abs("v")), "grp").limit(12)


@query(f"""WITH {STAYS_SQL}, n AS (SELECT *, lead(enter) OVER w AS next_enter, lead(site) OVER w AS next_site FROM stays WINDOW w AS (PARTITION BY vehicle ORDER BY enter, leave, seq, site, part))
SELECT site, count(*) FILTER (WHERE next_enter - leave < {5 * DAY} AND next_enter >= leave) AS quick, count(*) FILTER (WHERE leave - enter < {3 * HOUR}) AS blinks, count(*) FILTER (WHERE next_site = site) AS again FROM n GROUP BY site""")
def a74_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of a bad run: quick re-entries, blink visits."""
    w = Window.partitionBy("vehicle").orderBy("enter", "leave", "seq", "site", "part")
    n = stays(spark, sf_dir).withColumns({"next_enter": F.lead("enter").over(w), "next_site": F.lead("site").over(w)})
    after = F.col("next_enter") - F.col("leave")
    return n.groupBy("site").agg(F.count_if((after < 5 * DAY) & (after >= 0)).alias("quick"), F.count_if(F.col("leave") - F.col("enter") < 3 * HOUR).alias("blinks"), F.count_if(F.col("next_site") == F.col("site")).alias("again"))


@query(f"""WITH {PINGS_SQL}, a AS (SELECT event_id, vehicle, 'overspeed' AS kind, 3 AS severity FROM pings WHERE speed > 7000 UNION ALL SELECT event_id, vehicle, 'night', 1 FROM pings WHERE (us // {HOUR}) % 24 < 4 AND moving
 UNION ALL SELECT event_id, vehicle, 'harsh', 2 FROM (SELECT *, speed - lag(speed) {_W} AS d, us - lag(us) {_W} AS g FROM pings) x WHERE abs(d) > 3000 AND g < {6 * HOUR})
SELECT vehicle, kind, severity, count(*) AS alerts, min(event_id) AS first_event FROM a GROUP BY ALL""")
def w16_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of several kinds from one walk over each series."""
    w = S.series("vehicle", *_ORDER)
    df = pings(spark, sf_dir).withColumns({"d": F.col("speed") - F.lag("speed").over(w), "g": F.col("us") - F.lag("us").over(w)})
    rule = lambda test, kind, severity: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    rules = [
        rule(F.col("speed") > 7000, "overspeed", 3),
        rule((F.floor(F.col("us") / HOUR) % 24 < 4) & F.col("moving"), "night", 1),
        rule((F.abs("d") > 3000) & (F.col("g") < 6 * HOUR), "harsh", 2),
    ]
    one = df.select("event_id", "vehicle", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("x"))
    return one.groupBy("vehicle", "x.kind", "x.severity").agg(_n().alias("alerts"), F.min("event_id").alias("first_event")).select("vehicle", "kind", "severity", "alerts", "first_event")


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, max(us) OVER (PARTITION BY vehicle) AS newest, row_number() OVER (PARTITION BY vehicle ORDER BY us DESC, event_id DESC) AS rn FROM pings)
SELECT vehicle, count(*) FILTER (WHERE us > newest - {DAY} AND moving) AS day_moving, count(*) FILTER (WHERE us > newest - {7 * DAY} AND (us // {HOUR}) % 24 < 5) AS week_nights, sum(speed) FILTER (WHERE rn <= 20 AND moving) AS last_20, count(*) FILTER (WHERE rn <= 20 AND speed > 5000) AS last_20_fast FROM n GROUP BY vehicle""", whole=("last_20",))
def w23_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fatigue features: the day and the week before each driver's newest fix, and the last twenty fixes."""
    df = pings(spark, sf_dir).withColumns({"newest": F.max("us").over(Window.partitionBy("vehicle")), "rn": F.row_number().over(Window.partitionBy("vehicle").orderBy(F.desc("us"), F.desc("event_id")))})
    since, last = lambda t: F.col("us") > F.col("newest") - t, F.col("rn") <= 20
    return df.groupBy("vehicle").agg(F.count_if(since(DAY) & F.col("moving")).alias("day_moving"), F.count_if(since(7 * DAY) & (F.floor(F.col("us") / HOUR) % 24 < 5)).alias("week_nights"), F.sum(F.when(last & F.col("moving"), F.col("speed"))).alias("last_20"), F.count_if(last & (F.col("speed") > 5000)).alias("last_20_fast"))


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, lag(us) {_W} AS b_us, lag(k) {_W} AS b_k FROM pings), t AS (SELECT event_id, vehicle, b_us, us, b_k, k, (us // {DAY}) * {DAY} AS midnight FROM n)
SELECT event_id, vehicle, midnight, b_k + (k - b_k) * CAST(midnight - b_us AS DOUBLE) / (us - b_us) AS k_at FROM t WHERE b_us < midnight""")
def w38_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading at midnight, between the fixes around it."""
    w = S.series("vehicle", *_ORDER)
    t = pings(spark, sf_dir).withColumns({"b_us": F.lag("us").over(w), "b_k": F.lag("k").over(w), "midnight": F.floor(F.col("us") / DAY) * DAY}).where("b_us < midnight")
    at = F.col("b_k") + (F.col("k") - F.col("b_k")) * (F.col("midnight") - F.col("b_us")).cast("double") / (F.col("us") - F.col("b_us"))
    return t.select("event_id", "vehicle", "midnight", at.alias("k_at"))


@query(f"""WITH {PINGS_SQL}, s AS (SELECT *, CASE WHEN moving IS DISTINCT FROM lag(moving) {_W} THEN 1 ELSE 0 END AS new FROM pings), g AS (SELECT *, sum(new) {_ROWS} AS run FROM s)
SELECT event_id, vehicle, median(k) OVER (PARTITION BY vehicle, run ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS fitted FROM g""")
def w33_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of up to three fixes either side, within a run."""
    df = S.islands(pings(spark, sf_dir), "vehicle", _ORDER, S.changed("moving", "vehicle", _ORDER), "run")
    around = F.array_sort(F.collect_list("k").over(S.series(["vehicle", "run"], *_ORDER).rowsBetween(-3, 3)))
    n = F.size("around")
    low, high = F.get("around", F.floor((n - 1) / 2).cast("int")), F.get("around", F.floor(n / 2).cast("int"))
    return df.withColumn("around", around).select("event_id", "vehicle", ((low + high) / 2.0).alias("fitted"))


@query(f"""WITH {STAYS_SQL}, m0 AS (SELECT *, max(leave) OVER w AS reach FROM stays WINDOW w AS (PARTITION BY vehicle ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0)
SELECT vehicle, min(enter) AS enter, max(leave) AS leave, arg_max(site, (leave - enter, -site, -part)) AS outer_site, arg_min(site, (leave - enter, site, part)) AS inner_site FROM m1 GROUP BY vehicle, grp""")
def i07_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested stays as places: the largest names a place, the smallest locates it."""
    order = Window.partitionBy("vehicle").orderBy("enter", "leave")
    df = stays(spark, sf_dir).withColumn("reach", F.max("leave").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("grp", F.sum(F.when(F.col("enter") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("leave") - F.col("enter")
    return df.groupBy("vehicle", "grp").agg(F.min("enter").alias("enter"), F.max("leave").alias("leave"), F.max_by("site", F.struct(size, -F.col("site"), -F.col("part"))).alias("outer_site"), F.min_by("site", F.struct(size, "site", "part")).alias("inner_site")).drop("grp")


@query(f"""WITH {TRIPS_SQL}, p AS (SELECT trip, 'booking' AS phase, 1 AS n, date_sub('hour', booked, started) AS hours FROM trips WHERE started IS NOT NULL UNION ALL SELECT trip, 'transit', 2, date_sub('hour', started, ended) FROM trips WHERE started IS NOT NULL)
SELECT trip, phase, hours, hours < 0 AS anomaly, CASE WHEN hours >= 0 THEN 100.0 * hours / nullif(sum(CASE WHEN hours >= 0 THEN hours END) OVER (PARTITION BY trip), 0) END AS share FROM p""")
def i12_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared phases of a trip; a negative phase is an anomaly and takes no share."""
    df = trips(spark, sf_dir).where("started is not null")
    rows = F.array(F.struct(F.lit("booking").alias("phase"), F.timestamp_diff("HOUR", "booked", "started").alias("hours")), F.struct(F.lit("transit").alias("phase"), F.timestamp_diff("HOUR", "started", "ended").alias("hours")))
    p = df.select("trip", F.explode(rows).alias("x")).select("trip", "x.*")
    good = F.when(F.col("hours") >= 0, F.col("hours"))
    return p.select("trip", "phase", "hours", (F.col("hours") < 0).alias("anomaly"), (100.0 * good / F.nullif(F.sum(good).over(Window.partitionBy("trip")), F.lit(0))).alias("share"))


@query(f"""WITH {STAYS_SQL}, g AS (SELECT site, enter // {DAY} AS a, leave // {DAY} AS b FROM stays WHERE flag = 'R'), m0 AS (SELECT *, max(b) OVER (PARTITION BY site ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
m1 AS (SELECT *, sum(CASE WHEN a <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0) SELECT site, min(a) AS from_day, max(b) AS to_day, count(*) AS n FROM m1 GROUP BY site, grp""")
def i25_gap_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing spans in whole days; those a day apart or less are one."""
    g = stays(spark, sf_dir).where("flag = 'R'").select("site", F.floor(F.col("enter") / DAY).alias("from_day"), F.floor(F.col("leave") / DAY).alias("to_day"))
    return I.merged(g, ["site"], "from_day", "to_day", tolerance_us=1)


@query(f"""WITH {PLACED_SQL}, f AS (SELECT n_nationkey AS fence, 20 + n_nationkey * 0.37::DOUBLE AS lat0, 75 + n_nationkey * 0.21::DOUBLE AS lon0 FROM nation),
h AS (SELECT event_id, fence, pow(lat - lat0, 2) + pow(lon - lon0, 2) AS d FROM placed, f WHERE abs(lat - lat0) <= 0.3 AND abs(lon - lon0) <= 0.3)
SELECT fence, count(*) AS fixes, count(DISTINCT event_id) AS events FROM h WHERE d <= 0.04 GROUP BY fence""")
def j12_circle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in circles (radius in degrees), by cells and a residual test."""
    fences = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fence"), (20 + F.col("n_nationkey") * F.lit(0.37)).alias("lat0"), (75 + F.col("n_nationkey") * F.lit(0.21)).alias("lon0"))
    size = 0.2
    around = F.array(*[F.struct((F.floor(F.col("lat0") / size) + i).alias("cy"), (F.floor(F.col("lon0") / size) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = fences.withColumn("c", F.explode(around)).select("*", "c.cy", "c.cx").drop("c")
    df = placed(spark, sf_dir).withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.floor(F.col("lon") / size)})
    d = F.pow(F.col("lat") - F.col("lat0"), 2) + F.pow(F.col("lon") - F.col("lon0"), 2)
    return df.join(spread, ["cy", "cx"]).where(d <= 0.04).groupBy("fence").agg(_n().alias("fixes"), F.countDistinct("event_id").alias("events"))


@query(f"""WITH {PINGS_SQL}, w AS (SELECT vehicle % 10 AS lane, us // {HOUR} AS hour, avg(k) AS k FROM pings WHERE event_type = 'signup' GROUP BY ALL) SELECT p.event_id, CASE WHEN w.k IS NULL THEN 'unknown' WHEN w.k > 60 THEN 'storm' WHEN w.k > 30 THEN 'rain' ELSE 'clear' END AS weather FROM pings p LEFT JOIN w ON w.lane = p.vehicle % 10 AND w.hour = p.us // {HOUR}""")
def j10_hourly_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly side table joined by (cell, hour)."""
    df = pings(spark, sf_dir).withColumns({"lane": F.col("vehicle") % 10, "hour": F.floor(F.col("us") / HOUR)})
    w = df.where("event_type = 'signup'").groupBy("lane", "hour").agg(F.avg("k").alias("w"))
    k = F.col("w")
    return df.join(w, ["lane", "hour"], "left").select("event_id", F.when(k.isNull(), "unknown").when(k > 60, "storm").when(k > 30, "rain").otherwise("clear").alias("weather"))


@query(f"""WITH {STAYS_SQL}, {PINGS_SQL}, v AS (SELECT vehicle, vehicle % 20 AS site, us AS a, us + {DAY} AS b FROM pings)
SELECT v.vehicle, v.a, count(*) AS fixes, count(*) FILTER (WHERE speed > 4000) AS fast, arg_max(event_id, (speed, event_id)) AS worst FROM v JOIN pings p ON p.vehicle = v.vehicle AND p.us >= v.a AND p.us < v.b GROUP BY ALL""")
def m08_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst fix and the number of violations inside each visit."""
    df = pings(spark, sf_dir)
    visits = df.select("vehicle", F.col("us").alias("a"), (F.col("us") + DAY).alias("b"))
    fixes = df.select("vehicle", "us", (F.col("us") + 1).alias("us_end"), "speed", "event_id")
    held = I.overlap_join(visits, fixes, "vehicle", DAY, "a", "b", "us", "us_end")
    return held.groupBy("vehicle", "a").agg(_n().alias("fixes"), F.count_if(F.col("speed") > 4000).alias("fast"), F.max_by("event_id", F.struct("speed", "event_id")).alias("worst"))


@query(f"""WITH {TRIPS_SQL}, c AS (SELECT trip, price, qty, days, price - 100000 * coalesce(stops, 0) AS variance FROM trips) SELECT trip, variance, CASE WHEN days IS NULL THEN 'unknown' WHEN variance < 0 THEN 'saved' WHEN variance > price // 2 THEN 'overrun' ELSE 'normal' END AS verdict FROM c""")
def m13_trip_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trips(spark, sf_dir).withColumn("variance", F.col("price") - 100000 * F.coalesce("stops", F.lit(0)))
    v = F.col("variance")
    return df.select("trip", v.alias("variance"), F.when(F.col("days").isNull(), "unknown").when(v < 0, "saved").when(v > F.floor(F.col("price") / 2), "overrun").otherwise("normal").alias("verdict"))


@query(f"""WITH {PINGS_SQL}, s AS (SELECT event_id, us, lead(us) {_W} - us AS hold, (us // {HOUR}) % 24 AS hour FROM pings WHERE NOT moving) SELECT event_id, CASE WHEN hold IS NULL THEN 'open' WHEN hold < {6 * HOUR} THEN 'brief' WHEN hour >= 20 OR hour < 5 THEN 'overnight' WHEN hour BETWEEN 12 AND 14 THEN 'meal' WHEN hold > {48 * HOUR} THEN 'long' ELSE 'halt' END AS kind FROM s""")
def m15_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halt taxonomy: ordered rules on duration and clock."""
    w = S.series("vehicle", *_ORDER)
    s = pings(spark, sf_dir).where("not moving").select("event_id", (F.lead("us").over(w) - F.col("us")).alias("hold"), (F.floor(F.col("us") / HOUR) % 24).alias("hour"))
    hold, hour = F.col("hold"), F.col("hour")
    kind = F.when(hold.isNull(), "open").when(hold < 6 * HOUR, "brief").when((hour >= 20) | (hour < 5), "overnight").when(hour.between(12, 14), "meal").when(hold > 48 * HOUR, "long").otherwise("halt")
    return s.select("event_id", kind.alias("kind"))


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT carrier, sum(on_time) AS hits, count(on_time) AS n FROM trips WHERE carrier IS NOT NULL GROUP BY carrier), t AS (SELECT CAST(sum(hits) AS DOUBLE) / sum(n) AS prior FROM g) SELECT carrier, (coalesce(hits, 0) + 10 * prior) / (n + 10) AS smoothed FROM g, t""")
def f27_smoothed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates pulled towards the fleet's by ten trips."""
    g = trips(spark, sf_dir).where("carrier is not null").groupBy("carrier").agg(F.sum("on_time").alias("hits"), F.count("on_time").alias("n"))
    t = g.agg((F.sum("hits").cast("double") / F.sum("n")).alias("prior"))
    return g.join(F.broadcast(t), how="cross").select("carrier", R.smoothed_rate(F.coalesce("hits", F.lit(0)), F.col("n"), F.col("prior"), 10).alias("smoothed"))


@query(f"WITH {PINGS_SQL} SELECT event_id, CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'day' ELSE 'evening' END AS bucket, h, CASE WHEN d >= 5 THEN 1 ELSE 0 END AS weekend FROM (SELECT event_id, (us // {HOUR}) % 24 AS h, (us // {DAY} + 3) % 7 AS d FROM pings) x")
def f28_temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, d = F.floor(F.col("us") / HOUR) % 24, (F.floor(F.col("us") / DAY) + 3) % 7
    return pings(spark, sf_dir).select("event_id", F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "day").otherwise("evening").alias("bucket"), h.alias("h"), (d >= 5).cast("int").alias("weekend"))


@query("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus) AS signature, '{\"id\":' || CAST(o_orderkey AS VARCHAR) || ',\"status\":\"' || o_orderstatus || '\"}' AS doc FROM orders")
def f20_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and JSON of rows."""
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("signature"), doc.alias("doc"))


@query(f"WITH {TRIPS_SQL}, d AS (SELECT origin AS node FROM trips WHERE origin IS NOT NULL UNION ALL SELECT dest FROM trips WHERE dest IS NOT NULL) SELECT node, count(*) AS degree FROM d GROUP BY node")
def g23_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trips(spark, sf_dir)
    ends = df.select(F.explode(F.array("origin", "dest")).alias("node")).where("node is not null")
    return ends.groupBy("node").agg(_n().alias("degree"))
