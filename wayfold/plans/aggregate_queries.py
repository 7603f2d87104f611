"""Scorecards, rollups, distributions, rankings, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import rates as R
from wayfold.operators import intervals as I
from wayfold.operators import merges as K
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, TRIPS_SQL, pings, placed, read, trips



def _n() -> Column:
    return F.count(F.lit(1))


@query(f"WITH {TRIPS_SQL} SELECT count(*) AS trips, count(DISTINCT customer) AS customers, count(DISTINCT carrier) AS carriers, sum(qty) AS qty, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS on_time_pct, sum(days) / CAST(count(days) AS DOUBLE) AS avg_days FROM trips", whole=("qty",))
def a01_fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).agg(
        _n().alias("trips"), F.countDistinct("customer").alias("customers"), F.countDistinct("carrier").alias("carriers"), F.sum("qty").alias("qty"),
        R.known_rate(F.col("on_time")).alias("on_time_pct"), (F.sum("days") / F.count("days").cast("double")).alias("avg_days"),
    )


@query(f"""WITH {TRIPS_SQL} SELECT carrier, count(*) AS trips, count(DISTINCT customer) AS customers, sum(qty) AS qty, sum(price) AS price, count(on_time) AS known, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS on_time_pct,
 median(days) AS median_days, CAST(floor(quantile_cont(days, 0.9) * 10 + 0.5) AS BIGINT) AS p90_tenths, max(days) AS worst_days FROM trips WHERE carrier IS NOT NULL GROUP BY carrier HAVING count(*) >= 3""", whole=("price", "qty",))
def a03_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per carrier: volumes, rates over known outcomes, exact percentiles.

    One pass counts by carrier, customer and days; sums, percentiles of the counts and distinct customers come from that.
    """
    known = trips(spark, sf_dir, lanes=False).where("carrier is not null")
    fine = known.groupBy("carrier", "customer", "days").agg(
        _n().alias("n"), F.sum("qty").alias("qty"), F.sum("price").alias("price"), F.count("on_time").alias("known"), F.sum("on_time").alias("met")
    )
    facts = fine.groupBy("carrier").agg(
        F.sum("n").alias("trips"),
        F.sum("qty").alias("qty"),
        F.sum("price").alias("price"),
        F.sum("known").alias("known"),
        F.try_divide(100.0 * F.sum("met"), F.sum("known")).alias("on_time_pct"),
        F.percentile("days", 0.5, F.col("n")).alias("median_days"),
        F.floor(F.percentile("days", 0.9, F.col("n")) * 10 + 0.5).alias("p90_tenths"),
        F.max("days").alias("worst_days"),
    )
    customers = fine.select("carrier", "customer").distinct().groupBy("carrier").agg(_n().alias("customers"))
    return facts.where("trips >= 3").join(customers, "carrier")


@query(f"""WITH {TRIPS_SQL}, b AS (SELECT 1 FROM trips), w AS (SELECT CASE WHEN booked >= TIMESTAMP '1998-01-01' THEN 'now' ELSE 'before' END AS period, * FROM trips WHERE booked >= TIMESTAMP '1997-01-01' AND booked < TIMESTAMP '1999-01-01')
SELECT count(*) FILTER (WHERE period = 'now') AS trips, count(*) FILTER (WHERE period = 'before') AS trips_before,
 100.0 * (count(*) FILTER (WHERE period = 'now') - count(*) FILTER (WHERE period = 'before')) / nullif(count(*) FILTER (WHERE period = 'before'), 0) AS change_pct FROM w""")
def a07_previous_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure and the same figure over the equal window before, from one scan."""
    df = trips(spark, sf_dir).where("booked >= '1997-01-01' and booked < '1999-01-01'")
    now, before = F.count_if(F.col("booked") >= "1998-01-01"), F.count_if(F.col("booked") < "1998-01-01")
    return df.agg(now.alias("trips"), before.alias("trips_before"), (100.0 * (now - before) / F.nullif(before, F.lit(0))).alias("change_pct"))


@query(f"""WITH {TRIPS_SQL} SELECT strftime(booked, '%G-W%V') AS week, count(*) AS trips, sum(price) AS price, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS on_time_pct FROM trips GROUP BY ALL""", whole=("price",))
def a08_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfold.functions.scalars import iso_week

    return trips(spark, sf_dir).groupBy(iso_week(F.col("booked")).alias("week")).agg(_n().alias("trips"), F.sum("price").alias("price"), R.known_rate(F.col("on_time")).alias("on_time_pct"))


_Z = R.Z95


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT carrier, CAST(sum(on_time) AS DOUBLE) AS hits, CAST(nullif(count(on_time), 0) AS DOUBLE) AS n FROM trips WHERE carrier IS NOT NULL GROUP BY carrier)
SELECT carrier, CAST(floor(1e6 * (hits / n + {_Z}::DOUBLE * {_Z}::DOUBLE / (2 * n) - {_Z}::DOUBLE * sqrt(hits / n * (1 - hits / n) / n + {_Z}::DOUBLE * {_Z}::DOUBLE / (4 * n * n))) / (1 + {_Z}::DOUBLE * {_Z}::DOUBLE / n) + 0.5) AS BIGINT) AS low_ppm FROM g""")
def a09_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower Wilson bound of the on-time rate, in parts per million."""
    g = trips(spark, sf_dir).where("carrier is not null").groupBy("carrier").agg(F.sum("on_time").alias("hits"), F.count("on_time").alias("n"))
    return g.select("carrier", F.floor(1e6 * R.wilson(F.col("hits").cast("double"), F.col("n"), False) + 0.5).alias("low_ppm"))


@query(f"""WITH {TRIPS_SQL}, c AS (SELECT customer, carrier, count(*) AS n, min(trip) AS first_trip FROM trips WHERE carrier IS NOT NULL GROUP BY ALL)
SELECT customer, arg_max(carrier, (n, -carrier)) AS modal, arg_max(carrier, (n, -first_trip)) AS majority FROM c GROUP BY customer""")
def a10_modal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent carrier of a customer: ties to the smallest, or to the first seen."""
    c = trips(spark, sf_dir).where("carrier is not null").groupBy("customer", "carrier").agg(_n().alias("n"), F.min("trip").alias("first_trip"))
    return c.groupBy("customer").agg(F.max_by("carrier", F.struct("n", -F.col("carrier"))).alias("modal"), F.max_by("carrier", F.struct("n", -F.col("first_trip"))).alias("majority"))


@query("""WITH s AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '  ' || p_name ELSE p_name END AS spelt FROM part), f AS (SELECT lower(regexp_replace(trim(spelt), '\\s+', ' ', 'g')) AS key, trim(spelt) AS spelt FROM s),
c AS (SELECT key, spelt, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, spelt) AS rn, sum(n) OVER (PARTITION BY key) AS rows FROM c) SELECT key, spelt, CAST(rows AS BIGINT) AS rows FROM r WHERE rn = 1""")
def a13_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent spelling of each folded name, ties in order of the alphabet."""
    from wayfold.functions.scalars import folded

    i = F.col("p_partkey") % 3
    spelt = F.when(i == 0, F.upper("p_name")).when(i == 1, F.concat(F.lit("  "), "p_name")).otherwise(F.col("p_name"))
    c = read(spark, sf_dir, "part").groupBy(folded(spelt).alias("key"), F.trim(spelt).alias("spelt")).agg(_n().alias("n"))
    w = Window.partitionBy("key")
    return c.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("n"), "spelt")), "rows": F.sum("n").over(w)}).where("rn = 1").select("key", "spelt", "rows")


@query(f"""WITH {TRIPS_SQL} SELECT coalesce(customer, 0) AS customer, dest, CAST(grouping(customer) AS INTEGER) AS is_all, count(*) AS trips, count(DISTINCT carrier) AS carriers, sum(price) AS price FROM trips GROUP BY GROUPING SETS ((dest, customer), (dest))""", whole=("price",))
def a14_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer and over all, from one scan, with true distinct counts at both levels."""
    df = trips(spark, sf_dir).select("customer", "dest", "carrier", "price")
    out = df.groupingSets([["dest", "customer"], ["dest"]], "dest", "customer").agg(F.grouping("customer").cast("int").alias("is_all"), _n().alias("trips"), F.countDistinct("carrier").alias("carriers"), F.sum("price").alias("price"))
    return out.select(F.coalesce("customer", F.lit(0)).alias("customer"), "dest", "is_all", "trips", "carriers", "price")


@query(f"""WITH {TRIPS_SQL} SELECT origin, dest, extract('isodow' FROM booked) - 1 AS weekday, count(*) AS trips, median(days) AS days FROM trips WHERE dest IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def a17_route_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).where("dest is not null").groupBy("origin", "dest", F.weekday("booked").cast("long").alias("weekday")).agg(_n().alias("trips"), F.median("days").alias("days")).where("trips >= 2")


@query(f"WITH {TRIPS_SQL} SELECT carrier, count(*) AS trips, sum(price) AS price FROM trips WHERE carrier IS NOT NULL GROUP BY carrier", whole=("price",))
def a18_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only groups touched by new trips are recomputed; the result is that of a full rebuild."""
    df = trips(spark, sf_dir).where("carrier is not null").select("trip", "carrier", "price")
    summarise = lambda rows: rows.groupBy("carrier").agg(_n().alias("trips"), F.sum("price").alias("price"))
    before = summarise(df.where("trip % 11 <> 0"))
    touched = df.where("trip % 11 = 0").select("carrier").distinct()
    return K.replace_keys(before, summarise(df.join(touched, "carrier", "left_semi")), touched, ["carrier"])


@query(f"""WITH {PINGS_SQL}, g AS (SELECT *, least(coalesce(us - lag(us) OVER (PARTITION BY vehicle ORDER BY us, event_id), 0), {6 * HOUR}) AS gap FROM pings)
SELECT vehicle % 10 AS lane, (us // {HOUR}) % 24 AS hour, speed // 100 AS kmph, count(*) AS fixes, CAST(sum(gap) AS BIGINT) AS gap_us FROM g GROUP BY ALL""")
def a19_speed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram from which every speed figure is drawn."""
    from wayfold.operators.sequences import with_gap

    df = with_gap(pings(spark, sf_dir), "vehicle", ["us", "event_id"], cap_us=6 * HOUR)
    keys = [(F.col("vehicle") % 10).alias("lane"), (F.floor(F.col("us") / HOUR) % 24).alias("hour"), F.floor(F.col("speed") / 100).alias("kmph")]
    return df.groupBy(*keys).agg(_n().alias("fixes"), F.sum("gap_us").alias("gap_us"))


@query(f"""WITH {PINGS_SQL}, g AS (SELECT vehicle % 10 AS lane, speed // 100 AS kmph, least(coalesce(us - lag(us) OVER (PARTITION BY vehicle ORDER BY us, event_id), 0), {6 * HOUR}) AS gap, moving FROM pings),
h AS (SELECT lane, kmph, sum(gap) AS w FROM g WHERE moving GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY lane ORDER BY kmph) AS so_far, sum(w) OVER (PARTITION BY lane) AS total FROM h)
SELECT lane, min(kmph) AS p85 FROM c WHERE so_far >= total * 0.85 GROUP BY lane""")
def a21_weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speed below which vehicles spend 85 % of their moving time."""
    from wayfold.operators.sequences import with_gap

    df = with_gap(pings(spark, sf_dir), "vehicle", ["us", "event_id"], cap_us=6 * HOUR).where("moving")
    hist = df.groupBy((F.col("vehicle") % 10).alias("lane"), F.floor(F.col("speed") / 100).alias("kmph")).agg(F.sum("gap_us").alias("w"))
    return I.weighted_percentile(hist, ["lane"], "kmph", "w", 0.85).withColumnRenamed("kmph", "p85")


@query(f"""WITH {PINGS_SQL} SELECT event_type, list_sort(list(speed))[CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90_floor, list_sort(list(speed))[count(*) // 2 + 1] AS upper_median, median(speed) AS true_median, quantile_cont(speed, 0.75) AS p75 FROM pings GROUP BY ALL""")
def a26_percentile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four percentile rules side by side: floored index, upper middle, true median, linear. All from counts of values."""
    counts = pings(spark, sf_dir).groupBy("event_type", "speed").agg(F.count(F.lit(1)).alias("n"))
    floored = R.rank_value(counts, ["event_type"], "speed", "n", lambda n: F.floor(n * F.lit(0.9)) + 1).withColumnRenamed("speed", "p90_floor")
    upper = R.rank_value(counts, ["event_type"], "speed", "n", lambda n: F.floor(n / 2) + 1).withColumnRenamed("speed", "upper_median")
    rest = counts.groupBy("event_type").agg(F.percentile("speed", 0.5, F.col("n")).alias("true_median"), F.percentile("speed", 0.75, F.col("n")).alias("p75"))
    return floored.join(upper, "event_type").join(rest, "event_type")


@query(f"WITH {TRIPS_SQL} SELECT status, count(days) AS n, min(days) AS lo, max(days) AS hi, quantile_cont(days, 0.1) AS p10, median(days) AS p50, quantile_cont(days, 0.9) AS p90, sum(days) AS total, sum(days * days) AS squares FROM trips GROUP BY status", whole=("squares", "total",))
def a28_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("days", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = trips(spark, sf_dir).groupBy("status").agg(F.count("days").alias("n"), F.min("days").alias("lo"), F.max("days").alias("hi"), p.alias("p"), F.sum("days").alias("total"), F.sum(F.col("days") * F.col("days")).alias("squares"))
    return out.select("status", "n", "lo", "hi", F.get("p", 0).alias("p10"), F.get("p", 1).alias("p50"), F.get("p", 2).alias("p90"), "total", "squares")


@query(f"""WITH {PINGS_SQL}, s AS (SELECT min(speed) AS lo, max(speed) AS hi, least(30, greatest(CAST(floor(sqrt(count(*))) AS BIGINT) + 1, 5)) AS bins FROM pings)
SELECT least((speed - lo) * bins // (hi - lo), bins - 1) AS bin, count(*) AS n FROM pings, s GROUP BY ALL""")
def a29_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal-width histogram whose number of bins follows the data; the last bin is closed."""
    df = pings(spark, sf_dir)
    s = df.agg(F.min("speed").alias("lo"), F.max("speed").alias("hi"), F.least(F.lit(30), F.greatest(F.floor(F.sqrt(_n())) + 1, F.lit(5))).alias("bins"))
    bin_ = F.least(F.floor((F.col("speed") - F.col("lo")) * F.col("bins") / (F.col("hi") - F.col("lo"))), F.col("bins") - 1)
    return df.join(F.broadcast(s), how="cross").groupBy(bin_.alias("bin")).agg(_n().alias("n"))


@query(f"""WITH {TRIPS_SQL}, q AS (SELECT dest, quantile_cont(days, 0.25) AS q1, median(days) AS med, quantile_cont(days, 0.75) AS q3 FROM trips WHERE days IS NOT NULL GROUP BY dest)
SELECT t.dest, any_value(q1) AS q1, any_value(med) AS med, any_value(q3) AS q3, min(days) FILTER (WHERE days >= q1 - 1.5 * (q3 - q1)) AS low, max(days) FILTER (WHERE days <= q3 + 1.5 * (q3 - q1)) AS high,
 count(*) FILTER (WHERE days < q1 - 1.5 * (q3 - q1) OR days > q3 + 1.5 * (q3 - q1)) AS outliers FROM trips t JOIN q ON q.dest = t.dest WHERE days IS NOT NULL GROUP BY t.dest""")
def a33_box_plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trips(spark, sf_dir).where("days is not null and dest is not null").select("dest", "days")
    q = df.groupBy("dest").agg(F.percentile("days", 0.25).alias("q1"), F.median("days").alias("med"), F.percentile("days", 0.75).alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    d = F.col("days")
    return df.join(q, "dest").groupBy("dest").agg(F.first("q1").alias("q1"), F.first("med").alias("med"), F.first("q3").alias("q3"), F.min(F.when(d >= low, d)).alias("low"), F.max(F.when(d <= high, d)).alias("high"), F.count_if((d < low) | (d > high)).alias("outliers"))


@query(f"""WITH {TRIPS_SQL} SELECT extract('isodow' FROM booked) - 1 AS weekday, count(*) FILTER (WHERE status = 'F') AS F, count(*) FILTER (WHERE status = 'O') AS O, count(*) FILTER (WHERE status = 'P') AS P FROM trips GROUP BY ALL""")
def a35_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trips(spark, sf_dir).groupBy(F.weekday("booked").cast("long").alias("weekday")).pivot("status", ["F", "O", "P"]).agg(_n())
    return out.na.fill(0)


@query(f"""WITH {TRIPS_SQL}, f AS (SELECT count(*) AS booked, count(started) AS started, count(CASE WHEN ended > started THEN 1 END) AS moved, count(on_time) AS judged FROM trips)
SELECT 'booked' AS step, booked AS n FROM f UNION ALL SELECT 'started', started FROM f UNION ALL SELECT 'moved', moved FROM f UNION ALL SELECT 'judged', judged FROM f""")
def a36_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = trips(spark, sf_dir).agg(_n().alias("booked"), F.count("started").alias("started"), F.count(F.when(F.col("ended") > F.col("started"), 1)).alias("moved"), F.count("on_time").alias("judged"))
    return f.unpivot([], ["booked", "started", "moved", "judged"], "step", "n")


@query(f"""WITH {PLACED_SQL} SELECT CAST(floor(lat * 2) AS BIGINT) AS cy, CAST(floor(lon * 2) AS BIGINT) AS cx, count(*) AS fixes, count(DISTINCT vehicle) AS vehicles FROM placed GROUP BY ALL HAVING count(DISTINCT vehicle) >= 2""")
def a38_grid_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).groupBy(F.floor(F.col("lat") * 2).alias("cy"), F.floor(F.col("lon") * 2).alias("cx")).agg(_n().alias("fixes"), F.countDistinct("vehicle").alias("vehicles")).where("vehicles >= 2")


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT carrier, count(*) AS n, 100.0 * sum(on_time) / nullif(count(on_time), 0) AS otd, median(days) AS days FROM trips WHERE carrier IS NOT NULL GROUP BY carrier),
r AS (SELECT carrier, n, CASE WHEN otd IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY otd IS NULL ORDER BY otd) + (count(*) OVER (PARTITION BY otd) - 1) / 2.0::DOUBLE) / count(otd) OVER () END AS a,
 (rank() OVER (ORDER BY days DESC) + (count(*) OVER (PARTITION BY days) - 1) / 2.0::DOUBLE) / count(*) OVER () AS b FROM g)
SELECT carrier, n, CAST(floor(1e6 * (0.6::DOUBLE * coalesce(a, 0.5) + 0.4::DOUBLE * b) + 0.5) AS BIGINT) AS score_ppm FROM r""")
def a42_composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile ranks with ties averaged, weighted; an unknown axis counts as the middle."""
    g = trips(spark, sf_dir, lanes=False).where("carrier is not null").groupBy("carrier").agg(_n().alias("n"), R.known_rate(F.col("on_time")).alias("otd"), F.median("days").alias("days"))
    unknown = F.col("otd").isNull()
    a = (F.rank().over(Window.partitionBy(unknown).orderBy("otd")) + (_n().over(Window.partitionBy("otd")) - 1) / F.lit(2.0)) / F.count("otd").over(Window.partitionBy())
    b = (F.rank().over(Window.orderBy(F.desc("days"))) + (_n().over(Window.partitionBy("days")) - 1) / F.lit(2.0)) / _n().over(Window.partitionBy())
    ranked = g.select("carrier", "n", F.when(~unknown, a).alias("a"), b.alias("b"))
    return ranked.select("carrier", "n", F.floor(1e6 * (F.lit(0.6) * F.coalesce("a", F.lit(0.5)) + F.lit(0.4) * F.col("b")) + 0.5).alias("score_ppm"))


@query(f"""WITH {TRIPS_SQL}, g AS (SELECT origin, dest, carrier, count(*) AS n, sum(on_time) AS hits, median(days) AS days FROM trips WHERE carrier IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY origin, dest ORDER BY n DESC, coalesce(hits, -1) DESC, days, carrier) AS rn, count(*) OVER (PARTITION BY origin, dest) AS eligible FROM g)
SELECT origin, dest, carrier, n, eligible FROM r WHERE rn = 1 AND eligible >= 2""")
def a46_best_of_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trips(spark, sf_dir).where("carrier is not null").groupBy("origin", "dest", "carrier").agg(_n().alias("n"), F.sum("on_time").alias("hits"), F.median("days").alias("days"))
    w = Window.partitionBy("origin", "dest")
    r = g.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("n"), F.desc(F.coalesce("hits", F.lit(-1))), "days", "carrier")), "eligible": _n().over(w)})
    return r.where("rn = 1 and eligible >= 2").select("origin", "dest", "carrier", "n", "eligible")


@query(f"""WITH {TRIPS_SQL}, p AS (SELECT customer, count(*) AS n FROM trips GROUP BY customer), k AS (SELECT n FROM p ORDER BY n DESC, customer LIMIT 10)
SELECT (SELECT median(n) FROM p) AS median_trips, 100.0 * count(*) FILTER (WHERE n = 1) / count(*) AS single_pct, 100.0 * (SELECT sum(n) FROM k) / sum(n) AS top10_pct FROM p""")
def a48_fleet_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips per customer, the share of single-trip ones and the share of the ten largest: a top-k report."""
    p = trips(spark, sf_dir).groupBy("customer").agg(_n().alias("n"))
    top = p.orderBy(F.desc("n"), "customer").limit(10).agg(F.sum("n").alias("top"))
    facts = p.agg(F.median("n").alias("median_trips"), (100.0 * F.count_if(F.col("n") == 1) / _n()).alias("single_pct"), F.sum("n").alias("total"))
    return facts.join(top, how="cross").select("median_trips", "single_pct", (100.0 * F.col("top") / F.col("total")).alias("top10_pct"))


@query(f"""WITH {TRIPS_SQL}, d AS (SELECT carrier, customer, unnest(generate_series(CAST(started AS DATE), least(CAST(ended AS DATE), CAST(started AS DATE) + 13), INTERVAL 1 DAY)) AS day FROM trips WHERE started IS NOT NULL)
SELECT CAST(day AS DATE) AS day, count(*) AS trips, count(DISTINCT carrier) AS carriers FROM d GROUP BY ALL""")
def a54_daily_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips on the road per day; a trip counts on at most 14 days, as the measure is defined."""
    last = F.least(F.to_date("ended"), F.date_add(F.to_date("started"), 13))
    d = trips(spark, sf_dir, lanes=False).where("started is not null").select("carrier", F.explode(F.sequence(F.to_date("started"), last)).alias("day"))
    return d.groupBy("day").agg(_n().alias("trips"), F.countDistinct("carrier").alias("carriers"))


@query(f"""WITH {TRIPS_SQL} SELECT field, n, 100.0 * n / (SELECT count(*) FROM trips) AS fill_pct FROM (SELECT 'started' AS field, count(started) AS n FROM trips UNION ALL SELECT 'on_time', count(on_time) FROM trips UNION ALL SELECT 'dest', count(dest) FROM trips) x""")
def a75_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["started", "on_time", "dest"]
    facts = trips(spark, sf_dir).agg(_n().alias("all"), *[F.count(c).alias(c) for c in fields])
    return facts.unpivot(["all"], fields, "field", "n").select("field", "n", (100.0 * F.col("n") / F.col("all")).alias("fill_pct"))


@query(f"WITH {TRIPS_SQL} SELECT carrier, count(DISTINCT on_time) + max(CASE WHEN on_time IS NULL THEN 1 ELSE 0 END) AS kinds, count(DISTINCT customer) AS customers FROM trips GROUP BY carrier")
def a77_groups_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).groupBy("carrier").agg((F.countDistinct("on_time") + F.max(F.col("on_time").isNull().cast("int"))).alias("kinds"), F.countDistinct("customer").alias("customers"))


@query(f"WITH {TRIPS_SQL}, g AS (SELECT carrier, sum(price) AS price FROM trips WHERE carrier IS NOT NULL GROUP BY carrier) SELECT * FROM g ORDER BY price DESC, carrier LIMIT 10", whole=("price",))
def l01_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).where("carrier is not null").groupBy("carrier").agg(F.sum("price").alias("price")).orderBy(F.desc("price"), "carrier").limit(10)


@query(f"WITH {TRIPS_SQL} SELECT trip, on_time FROM trips ORDER BY on_time DESC NULLS LAST, trip LIMIT 25 OFFSET 50")
def l02_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25, unknown outcomes last."""
    return trips(spark, sf_dir).select("trip", "on_time").orderBy(F.desc_nulls_last("on_time"), "trip").offset(50).limit(25)


@query("SELECT p_partkey, list_position(['ECONOMY', 'STANDARD', 'PROMO'], p_type) AS place FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')")
def l05_enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*[F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO")])
    place = F.array_position(order, F.col("p_type")).cast("int")
    return read(spark, sf_dir, "part").where(place > 0).select("p_partkey", place.alias("place")).orderBy("place", "p_partkey")


@query("SELECT DISTINCT n_nationkey AS key FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION SELECT s_nationkey FROM supplier")
def u01_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_nationkey").alias("key"))
    return nation.union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u03_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return own("F").intersect(own("O"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u04_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return own("F").subtract(own("O"))


@query(f"""WITH RECURSIVE {TRIPS_SQL}, e AS (SELECT origin AS a, dest AS b, min(days) AS cost FROM trips WHERE dest IS NOT NULL AND origin <> dest AND days > 0 GROUP BY ALL),
p AS (SELECT a AS src, b AS node, [a, b] AS path, cost FROM e WHERE a = 0 UNION ALL SELECT src, e.b, list_append(path, e.b), p.cost + e.cost FROM p JOIN e ON e.a = p.node WHERE NOT list_contains(path, e.b) AND len(path) < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, len(path), array_to_string(path, '-')) AS rn FROM p) SELECT node AS dest, CAST(rn AS INTEGER) AS rn, CAST(cost AS BIGINT) AS cost, array_to_string(path, '-') AS path FROM r WHERE rn <= 3""")
def g22_k_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cheapest simple paths of at most three stops from one origin, by unrolled joins over the edges."""
    e = trips(spark, sf_dir).where("dest is not null and origin <> dest and days > 0").groupBy(F.col("origin").alias("a"), F.col("dest").alias("b")).agg(F.min("days").alias("c"))
    paths = e.where("a = 0").select(F.col("b").alias("at"), F.array("a", "b").alias("path"), F.col("c").alias("cost"))
    found, step = paths, paths
    for _ in range(1):
        step = step.join(e, F.col("at") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"), (F.col("cost") + F.col("c")).alias("cost"))
        found = found.union(step)
    text = F.array_join(F.col("path").cast("array<string>"), "-")
    rn = F.row_number().over(Window.partitionBy("at").orderBy("cost", F.size("path"), "text"))
    return found.withColumn("text", text).withColumn("rn", rn).where("rn <= 3").select(F.col("at").alias("dest"), "rn", "cost", F.col("text").alias("path"))
