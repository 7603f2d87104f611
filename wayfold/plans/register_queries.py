"""Sources with cursors, cell parsers, rates with overrides, audits, incremental refreshes and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars as X
from wayfold.operators import intervals as I
from wayfold.operators import merges as K
from wayfold.operators import sequences as S
from wayfold.operators.joins import known_by
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, STAYS_SQL, TRIPS_SQL, micros, pings, placed, read, stays, trips
from wayfold.sources.trails import TRAILS_SQL, trails

_ORDER = ["us", "event_id"]
_W = "OVER (PARTITION BY vehicle ORDER BY us, event_id)"
DAY = 24 * HOUR

#: Micro-degrees a second beyond which a step of the trails is too fast.
_FAST = 1.0


def _n():
    return F.count(F.lit(1))


@query("SELECT o_orderkey AS id, o_custkey AS batch FROM orders WHERE (o_custkey, o_orderkey) > (20, 100) ORDER BY o_custkey, o_orderkey LIMIT 200")
def s26_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a cursor over (batch, trip)."""
    after = (F.col("o_custkey") > 20) | (F.col("o_custkey") == 20) & (F.col("o_orderkey") > 100)
    return read(spark, sf_dir, "orders").where(after).orderBy("o_custkey", "o_orderkey").limit(200).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch"))


@query(f"WITH {PINGS_SQL}, c AS (SELECT min(us) + 5 * {DAY} AS now FROM pings) SELECT event_id, us FROM pings, c WHERE us <= now AND (us, event_id) > (now - {DAY}, 0)")
def s27_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay shows what lies before its virtual clock and after its cursor."""
    df = pings(spark, sf_dir)
    clock = df.agg((F.min("us") + 5 * DAY).alias("now"))
    after = (F.col("us") > F.col("now") - DAY) | (F.col("us") == F.col("now") - DAY) & (F.col("event_id") > 0)
    return df.crossJoin(F.broadcast(clock)).where((F.col("us") <= F.col("now")) & after).select("event_id", "us")


@query("SELECT o_orderkey AS trip_no, o_orderstatus AS trip_status, o_orderpriority AS class FROM orders WHERE o_orderstatus <> 'P'")
def s28_alias_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old names over a contract, as a view for SQL."""
    view = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumnsRenamed({"o_orderkey": "trip_no", "o_orderstatus": "trip_status", "o_orderpriority": "class"})
    view.createOrReplaceTempView("trips_by_contract")
    return spark.sql("SELECT trip_no, trip_status, class FROM trips_by_contract")


@query("SELECT o_orderkey // 1000 AS chunk, count(*) AS n, min(o_orderkey) AS from_id, max(o_orderkey) AS to_id FROM orders GROUP BY 1")
def k08_key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by ranges of keys, for targets that take no more at a time."""
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("chunk")).agg(_n().alias("n"), F.min("o_orderkey").alias("from_id"), F.max("o_orderkey").alias("to_id"))


@query("SELECT l_orderkey AS trip, count(*) AS rows_now, sum(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END) AS version FROM lineitem GROUP BY 1", whole=("version",))
def k06_replaced_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that were touched are taken from the new rows alone."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    old = read(spark, sf_dir, "lineitem").select(*keys).withColumn("version", F.lit(1))
    touched = old.where("l_linenumber % 2 = 0").select(*keys).distinct()
    rebuilt = old.where("l_linenumber % 2 = 0").withColumn("version", F.lit(2))
    now = K.replace_keys(old, rebuilt, touched, keys)
    return now.groupBy(F.col("l_orderkey").alias("trip")).agg(_n().alias("rows_now"), F.sum("version").alias("version"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type ELSE p_name END AS known FROM part")
def p02_first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three alternative fields that holds a value."""
    i = F.col("p_partkey") % 3
    a, b = F.when(i == 0, F.col("p_brand")).otherwise("n/a"), F.when(i < 2, F.col("p_type")).otherwise(" - ")
    return read(spark, sf_dir, "part").select("p_partkey", X.first_known(a, b, F.col("p_name")).alias("known"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(upper(p_type), '(^|[^A-Z0-9])(TIN|BRASS)($|[^A-Z0-9])') THEN 'metal' WHEN regexp_matches(upper(p_type), '(^|[^A-Z0-9])(SMALL|MEDIUM)($|[^A-Z0-9])') THEN 'size' ELSE 'other' END AS kind FROM part""")
def p21_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules on whole words: TIN does not match in PLATING."""
    return read(spark, sf_dir, "part").select("p_partkey", X.first_word_rule(F.col("p_type"), [("metal", ["TIN", "BRASS"]), ("size", ["SMALL", "MEDIUM"])], "other").alias("kind"))


@query("SELECT c_nationkey AS nation, 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'supplier', s_suppkey FROM supplier")
def u02_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, nation, kind, key: read(spark, sf_dir, name).select(F.col(nation).alias("nation"), F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part("customer", "c_nationkey", "customer", "c_custkey").unionByName(part("supplier", "s_nationkey", "supplier", "s_suppkey"))


@query(f"WITH {PINGS_SQL} SELECT event_id, us FROM pings WHERE (us, event_id) > (SELECT (us, event_id) FROM pings WHERE event_id = 77) ORDER BY us, event_id LIMIT 50")
def l09_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a row, by its keys instead of an offset."""
    df = pings(spark, sf_dir).select("event_id", "us")
    last = df.where("event_id = 77").select(F.col("us").alias("at"), F.col("event_id").alias("at_id"))
    after = (F.col("us") > F.col("at")) | (F.col("us") == F.col("at")) & (F.col("event_id") > F.col("at_id"))
    return df.crossJoin(F.broadcast(last)).where(after).orderBy("us", "event_id").limit(50).select("event_id", "us")


@query(f"""WITH {PINGS_SQL}, w AS (SELECT max(us) - 2 * {DAY} AS since FROM pings), r AS (SELECT vehicle, us, speed FROM pings, w WHERE us >= since UNION ALL SELECT vehicle, us, speed FROM pings, w WHERE us >= since + {DAY})
SELECT DISTINCT vehicle, us, speed FROM r""")
def t09_overlapping_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads that overlap by a look back give each fix once."""
    df = pings(spark, sf_dir)
    since = F.broadcast(df.agg((F.max("us") - 2 * DAY).alias("since")))
    first, second = df.crossJoin(since).where("us >= since"), df.crossJoin(since).where(F.col("us") >= F.col("since") + DAY)
    return first.unionByName(second).select("vehicle", "us", "speed").dropDuplicates()


@query(f"""WITH {STAYS_SQL} SELECT site, enter // {DAY} AS day, count(*) AS visits FROM stays GROUP BY ALL""")
def t11_refreshed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup of which the touched days alone are built again equals one that is built whole."""
    df = stays(spark, sf_dir).select("site", F.floor(F.col("enter") / DAY).alias("day"), "flag")
    # Dealt before it is summed: days of a site have few stays, and summed as they are read they would all be held.
    df = df.repartition(I.parts(df), "site", "day")
    roll = lambda rows: rows.groupBy("site", "day").agg(_n().alias("visits"))
    touched = df.where("flag = 'R'").select("site", "day").distinct()
    return K.replace_keys(roll(df.where("flag <> 'R'")), roll(df.join(touched, ["site", "day"], "left_semi")), touched, ["site", "day"])


_PATH = [(20.0, 75.0), (24.0, 77.0), (24.0, 79.0), (29.0, 80.5)]
_LEGS_SQL = "legs(leg, ay, ax, b_y, bx) AS (VALUES " + ", ".join(f"({i}::BIGINT, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(_PATH, _PATH[1:]))) + ")"


@query(f"""WITH {PLACED_SQL}, {_LEGS_SQL}, t AS (SELECT event_id, leg, lat, lon, ay, ax, b_y, bx, greatest(0.0, least(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t FROM placed, legs),
d AS (SELECT event_id, leg, pow(lon - ax - t * (bx - ax), 2) + pow(lat - ay - t * (b_y - ay), 2) AS off, t FROM t)
SELECT event_id, arg_min(leg, (off, leg)) AS leg, CAST(floor(1e5 * min(off) + 0.5) AS BIGINT) AS off_e5 FROM d GROUP BY event_id""")
def g14_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix on the nearest leg of a planned path, and how far off it is, in degrees of the plane. The path is a literal."""
    legs = F.array(*[F.struct(F.lit(i).cast("long").alias("leg"), *[F.lit(v).alias(n) for n, v in zip(("ay", "ax", "b_y", "bx"), (*a, *b))]) for i, (a, b) in enumerate(zip(_PATH, _PATH[1:]))])

    def met(e):
        dx, dy = e["bx"] - e["ax"], e["b_y"] - e["ay"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("lon") - e["ax"]) * dx + (F.col("lat") - e["ay"]) * dy) / (dx * dx + dy * dy)))
        return F.struct((F.pow(F.col("lon") - e["ax"] - t * dx, 2) + F.pow(F.col("lat") - e["ay"] - t * dy, 2)).alias("off"), e["leg"].alias("leg"))

    df = placed(spark, sf_dir).select("event_id", F.array_min(F.transform(legs, met)).alias("x"))
    return df.select("event_id", "x.leg", F.floor(1e5 * F.col("x.off") + 0.5).alias("off_e5"))


@query(f"""WITH {TRAILS_SQL}, l AS (SELECT *, row_number() {_W} AS pos, us - lag(us) {_W} AS gap, lat6 - lag(lat6) {_W} AS dy, lon6 - lag(lon6) {_W} AS dx FROM trails),
d AS (SELECT vehicle, us, pos, CASE WHEN gap IS NULL THEN 'kept' WHEN gap <= 0 THEN 'late' WHEN dy = 0 AND dx = 0 THEN 'repeat'
        WHEN sqrt(CAST(dy * dy + dx * dx AS DOUBLE)) > {_FAST}::DOUBLE * gap / 1000000 THEN 'too_fast' ELSE 'kept' END AS verdict FROM l)
SELECT vehicle, us // {DAY} AS day, verdict, count(*) AS n, min(pos) AS first_pos FROM d GROUP BY ALL""")
def c31_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and rejected fixes of each trail and day, with the reason: not later than the one before, at its place, or too fast from there."""
    w = S.series("vehicle", *_ORDER)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    df = trails(spark, sf_dir).select("vehicle", "us", F.row_number().over(w).cast("long").alias("pos"), step("us").alias("gap"), step("lat6").alias("dy"), step("lon6").alias("dx"))
    fast = F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double")) > F.lit(_FAST) * F.col("gap") / 1_000_000
    verdict = F.when(F.col("gap").isNull(), "kept").when(F.col("gap") <= 0, "late").when((F.col("dy") == 0) & (F.col("dx") == 0), "repeat").when(fast, "too_fast").otherwise("kept")
    return df.withColumn("verdict", verdict).groupBy("vehicle", F.floor(F.col("us") / DAY).alias("day"), "verdict").agg(_n().alias("n"), F.min("pos").alias("first_pos"))


@query("""WITH r AS (SELECT l_suppkey % 5 AS run, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL) SELECT run, sum(n) AS records, sum(n) FILTER (WHERE status = 'F') AS done, bool_and(n > 0) AND count(*) = 2 AS complete,
run = (SELECT max(run) FROM r) AS published FROM r GROUP BY run""", whole=("records", "done"))
def c33_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs recounted from their records, and which one is published."""
    r = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("run"), F.col("l_linestatus").alias("status")).agg(_n().alias("n"))
    runs = r.groupBy("run").agg(F.sum("n").alias("records"), F.sum(F.when(F.col("status") == "F", F.col("n"))).alias("done"), (_n() == 2).alias("complete"))
    return runs.crossJoin(F.broadcast(runs.agg(F.max("run").alias("last")))).select("run", "records", "done", "complete", (F.col("run") == F.col("last")).alias("published"))


@query(f"""WITH {PLACED_SQL} SELECT CAST(floor(lat * 1000 + 0.5) AS BIGINT) AS y, CAST(floor(lon * 1000 + 0.5) AS BIGINT) AS x, count(*) AS asked, min(event_id) AS first_asked FROM placed GROUP BY ALL""")
def c36_point_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points rounded to three decimals are asked for once."""
    y, x = F.floor(F.col("lat") * 1000 + 0.5), F.floor(F.col("lon") * 1000 + 0.5)
    return placed(spark, sf_dir).groupBy(y.alias("y"), x.alias("x")).agg(_n().alias("asked"), F.min("event_id").alias("first_asked"))


@query(f"""WITH {TRIPS_SQL}, r AS (SELECT origin, dest, count(*) AS n, median(days) AS days FROM trips WHERE dest IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM r WHERE origin = 1 AND dest = 2)
SELECT r.origin, r.dest, r.n, CASE WHEN r.origin = 1 THEN 2 ELSE 0 END + CASE WHEN r.dest = 2 THEN 2 ELSE 0 END + CASE WHEN abs(r.days - (SELECT days FROM t)) <= 10 THEN 1 ELSE 0 END AS likeness
FROM r WHERE NOT (r.origin = 1 AND r.dest = 2) ORDER BY likeness DESC, r.n DESC, r.origin, r.dest LIMIT 20""")
def c53_similar_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that share an end or take about as long."""
    r = trips(spark, sf_dir).where("dest is not null").groupBy("origin", "dest").agg(_n().alias("n"), F.median("days").alias("days"))
    own = r.where("origin = 1 and dest = 2").select(F.col("days").alias("own_days"))
    others = r.where("not (origin = 1 and dest = 2)").join(F.broadcast(own), how="left")
    points = lambda test, n: F.when(test, n).otherwise(0)
    likeness = points(F.col("origin") == 1, 2) + points(F.col("dest") == 2, 2) + points(F.abs(F.col("days") - F.col("own_days")) <= 10, 1)
    return others.withColumn("likeness", likeness).orderBy(F.desc("likeness"), F.desc("n"), "origin", "dest").limit(20).select("origin", "dest", "n", "likeness")


@query(f"WITH {PINGS_SQL} SELECT event_id, CASE WHEN k % 9 = 0 THEN NULL ELSE speed END AS speed, CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'gap' ELSE 'spike' END AS code FROM pings")
def c58_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a record by name, its marks for 'no value' as null."""
    stored = pings(spark, sf_dir).select("event_id", F.when(F.col("k") % 9 == 0, -1).otherwise(F.col("speed")).alias("speed"), (F.col("k") % 3).cast("string").alias("code"))
    return stored.select("event_id", F.when(F.col("speed") != -1, F.col("speed")).alias("speed"), X.spelt_out(F.col("code"), {"0": "ok", "1": "gap", "2": "spike"}).alias("code"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 80 + c_custkey % 7 END, CASE WHEN c_nationkey < 5 THEN 95 END, 100) AS rate FROM customer")
def c59_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of a tenant, else of its nation, else the common one."""
    who = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    own = who.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_custkey") % 7 + 80).alias("own"))
    nation = read(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(95).cast("long").alias("national"))
    return who.join(own, "c_custkey", "left").join(F.broadcast(nation), "c_nationkey", "left").select("c_custkey", F.coalesce("own", "national", F.lit(100).cast("long")).alias("rate"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def c62_timestamp_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold a spreadsheet's serial day, a text in one of the formats, or nothing that is a date."""
    i, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    serial = (F.datediff(F.to_date(d), F.lit("1899-12-30").cast("date"))).cast("string")
    cell = F.when(i == 0, serial).when(i == 4, "tomorrow").when(i == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_date(X.cell_timestamp(cell)).alias("day"))


@query("SELECT o_orderkey, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + (o_orderkey % 24 * 60 + o_orderkey % 60) * 60000000 AS us FROM orders")
def c63_date_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date cell and a clock cell, which may also be a share of the day, make one moment."""
    i, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    minutes = i % 24 * 60 + i % 60
    clock = F.when(i % 2 == 0, F.format_string("%02d:%02d", i % 24, i % 60)).otherwise((minutes / 1440).cast("string"))
    at = X.micros(day.cast("timestamp_ntz")) + X.clock_minutes(clock) * 60_000_000
    return read(spark, sf_dir, "orders").select("o_orderkey", at.alias("us"))


@query(f"""WITH {PINGS_SQL}, v AS (SELECT vehicle, max(speed) AS peak, avg(speed) AS mean FROM pings GROUP BY vehicle)
SELECT vehicle, peak, CASE WHEN peak < 7000 THEN 'low' WHEN peak < 8500 THEN 'medium' ELSE 'high' END AS severity, CASE WHEN mean > 0 THEN CAST(floor(10 * peak / mean + 0.5) AS BIGINT) END AS times_mean
FROM v ORDER BY peak DESC, vehicle LIMIT 100""")
def c67_anomaly_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred highest scores with their severity and how they compare with the mean."""
    v = pings(spark, sf_dir).groupBy("vehicle").agg(F.max("speed").alias("peak"), F.avg("speed").alias("mean")).orderBy(F.desc("peak"), "vehicle").limit(100)
    severity = F.when(F.col("peak") < 7000, "low").when(F.col("peak") < 8500, "medium").otherwise("high")
    return v.select("vehicle", "peak", severity.alias("severity"), F.when(F.col("mean") > 0, F.floor(10 * F.col("peak") / F.col("mean") + 0.5)).alias("times_mean"))


@query(f"""WITH {PLACED_SQL}, n AS (SELECT event_id, vehicle, us, row_number() {_W} AS pos, count(*) OVER (PARTITION BY vehicle) AS total FROM placed)
SELECT event_id, vehicle FROM n WHERE (pos - 1) % greatest(1, CAST(ceil(total / 5.0::DOUBLE) AS BIGINT)) = 0 OR pos = total""")
def c71_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for a map: every k-th fix, so that about five remain, and the last."""
    df = placed(spark, sf_dir).withColumn("pos", F.row_number().over(S.series("vehicle", *_ORDER)).cast("long")).withColumn("total", _n().over(Window.partitionBy("vehicle")))
    return df.where(((F.col("pos") - 1) % F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / 5)) == 0) | (F.col("pos") == F.col("total"))).select("event_id", "vehicle")


@query(f"""WITH {PINGS_SQL}, w AS (SELECT vehicle, us // {12 * HOUR} AS slot, max(speed) AS speed, max(k) AS weather FROM pings GROUP BY ALL), m AS (SELECT vehicle, median(speed) AS mid FROM w GROUP BY vehicle)
SELECT vehicle, count(*) AS slots, count(*) FILTER (WHERE speed < least(4000, greatest(500, 0.6::DOUBLE * mid)) AND weather >= 80) AS held_up FROM w JOIN m USING (vehicle) GROUP BY vehicle""")
def f23_weather_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are slow by a vehicle's own measure and adverse."""
    w = pings(spark, sf_dir).groupBy("vehicle", F.floor(F.col("us") / (12 * HOUR)).alias("slot")).agg(F.max("speed").alias("speed"), F.max("k").alias("weather"))
    mid = w.groupBy("vehicle").agg(F.median("speed").alias("mid"))
    slow = F.col("speed") < F.least(F.lit(4000.0), F.greatest(F.lit(500.0), F.lit(0.6) * F.col("mid")))
    return w.join(mid, "vehicle").groupBy("vehicle").agg(_n().alias("slots"), F.count_if(slow & (F.col("weather") >= 80)).alias("held_up"))


@query(f"""WITH {TRIPS_SQL} SELECT t.trip, count(s.trip) AS together, avg(s.on_time) AS rate, any_value(t.on_time) AS label FROM trips t
LEFT JOIN trips s ON s.carrier = t.carrier AND s.customer = t.customer AND s.ended < t.booked AND s.on_time IS NOT NULL WHERE t.on_time IS NOT NULL GROUP BY t.trip""")
def n02_sla_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a carrier had done for a customer when a trip was booked, beside the label: trips that had ended by then alone."""
    t = trips(spark, sf_dir, lanes=False).select("trip", "carrier", "customer", "on_time", micros("booked").alias("booked_us"), micros("ended").alias("ended_us"))
    found = known_by(t.where("on_time is not null"), t.where("carrier is not null"), ["carrier", "customer"], "booked_us", "ended_us", "on_time", "past")
    return found.select("trip", F.col("past_n").alias("together"), F.col("past_mean").alias("rate"), F.col("on_time").alias("label"))


@query(f"""WITH {TRIPS_SQL} SELECT carrier, 1000 * count(*) FILTER (WHERE on_time = 1) // nullif(count(on_time), 0) AS otd_per_mille, max(CASE WHEN on_time IS NULL THEN 1 ELSE 0 END) AS any_unknown, median(days) AS mid FROM trips GROUP BY carrier""")
def x06_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures that others use, side by side in one aggregation."""
    met = F.floor(F.try_divide(1000 * F.count_if(F.coalesce(F.col("on_time") == 1, F.lit(False))), F.count("on_time")))
    return trips(spark, sf_dir, lanes=False).groupBy("carrier").agg(met.alias("otd_per_mille"), F.max(F.col("on_time").isNull().cast("int")).alias("any_unknown"), F.median("days").alias("mid"))


@query(f"""WITH {STAYS_SQL} SELECT vehicle, seq, part, site, unnest(range(enter // {DAY}, greatest(enter, leave - 1) // {DAY} + 1)) AS day FROM stays""")
def x07_day_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each day that a stay touches."""
    days = F.sequence(F.floor(F.col("enter") / DAY), F.floor(F.greatest("enter", F.col("leave") - 1) / DAY))
    return stays(spark, sf_dir).select("vehicle", "seq", "part", "site", F.explode(days).alias("day"))


@query(f"""WITH {TRIPS_SQL}, p AS (SELECT 'late trips' AS figure, count(*) AS value FROM trips WHERE on_time = 0 UNION ALL SELECT 'long trips', count(*) FROM trips WHERE days > 80)
SELECT figure, value, (SELECT count(*) FROM trips) AS of_all FROM p""")
def a76_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures recounted from the rows that a proof shows; a figure and its rows share one filter."""
    proofs = {"late trips": "on_time = 0", "long trips": "days > 80"}
    counts = trips(spark, sf_dir, lanes=False).agg(_n().alias("of_all"), *[F.count_if(F.coalesce(F.expr(test), F.lit(False))).alias(f"n{i}") for i, test in enumerate(proofs.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("figure"), F.col(f"n{i}").alias("value"), "of_all") for i, name in enumerate(proofs)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


@query(f"""WITH {TRIPS_SQL} SELECT 'trips' AS dataset, count(*) AS records FROM trips UNION ALL SELECT 'visits', count(*) FROM lineitem UNION ALL SELECT 'fixes', count(*) FROM events UNION ALL SELECT 'alerts', count(*) FROM events WHERE event_type = 'error'""")
def a67_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets that drills offer, with their sizes."""
    events = read(spark, sf_dir, "events")
    sets = {"trips": read(spark, sf_dir, "orders"), "visits": read(spark, sf_dir, "lineitem"), "fixes": events, "alerts": events.where("event_type = 'error'")}
    out = None
    for name, df in sets.items():
        row = df.agg(F.lit(name).alias("dataset"), _n().alias("records"))
        out = row if out is None else out.unionByName(row)
    return out
