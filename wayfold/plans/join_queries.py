"""Joins, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars as X
from wayfold.operators import joins as J
from wayfold.operators import merges as K
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, STAYS_SQL, TRIPS_SQL, pings, placed, read, stays, trips

_ORDER = "OVER (PARTITION BY vehicle ORDER BY us, event_id)"


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def s01_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and columns reach the Parquet scan."""
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {PINGS_SQL} SELECT event_id, us, event_type FROM pings WHERE vehicle = 7")
def s04_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).where("vehicle = 7").select("event_id", "us", "event_type").orderBy("us", "event_id")


@query(f"WITH {PINGS_SQL} SELECT vehicle, count(*) AS fixes, min(us) AS first_us, max(us) AS last_us FROM pings GROUP BY vehicle HAVING count(*) >= 5")
def s05_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).groupBy("vehicle").agg(F.count(F.lit(1)).alias("fixes"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).where("fixes >= 5")


@query(f"WITH {PINGS_SQL} SELECT event_id, us FROM pings WHERE (us, event_id) > (1704500000000000, 500) ORDER BY us, event_id LIMIT 50")
def s06_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page of a keyset walk; the limit is the page."""
    after = (F.col("us") > 1704500000000000) | ((F.col("us") == 1704500000000000) & (F.col("event_id") > 500))
    return pings(spark, sf_dir).where(after).select("event_id", "us").orderBy("us", "event_id").limit(50)


@query("SELECT o_orderpriority, max(CAST(split_part(strftime(o_orderdate, '%d/%m/%Y'), '/', 1) AS INTEGER)) > 12 AS dayfirst FROM orders GROUP BY ALL")
def s14_dayfirst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a column of dates must be day-first: some first part exceeds 12."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.max(F.split(text, "/")[0].cast("int")) > 12).alias("dayfirst"))


@query(f"""WITH {STAYS_SQL} SELECT site, vehicle, seq, part, CAST(row_number() OVER (PARTITION BY site ORDER BY vehicle, seq, part) AS INTEGER) AS corner,
 lead(vehicle) OVER (PARTITION BY site ORDER BY vehicle, seq, part) AS next_vehicle FROM stays""")
def s16_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex rows get their place in the ring of their site and the vertex after them; a ring is never one value, however long."""
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy("vehicle", "seq", "part")
    df = stays(spark, sf_dir).select("site", "vehicle", "seq", "part")
    return df.withColumn("corner", F.row_number().over(w)).withColumn("next_vehicle", F.lead("vehicle").over(w))


@query(f"WITH {PINGS_SQL} SELECT DISTINCT vehicle FROM pings WHERE event_id > 800 AND event_id <= 900")
def s24_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series touched between two watermarks."""
    return pings(spark, sf_dir).where("event_id > 800 AND event_id <= 900").select("vehicle").distinct()


@query("""WITH d AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey % 7 <> 6), n AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM d)
SELECT min(id) AS from_id, max(id) AS to_id, count(*) AS n FROM n GROUP BY g""")
def s25_contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous ranges of ids. Range-partitioned: a range starts where the id before it is missing."""
    ids = read(spark, sf_dir, "orders").where("o_custkey % 7 <> 6").select(F.col("o_custkey").alias("id")).distinct()
    before, after = ids.select((F.col("id") + 1).alias("id")), ids.select((F.col("id") - 1).alias("id"))
    # Ends are found by anti-joins; each start then takes the nearest end of its block of ids and those after it.
    starts, ends = ids.join(before, "id", "left_anti"), ids.join(after, "id", "left_anti")
    marks = starts.select("id", F.lit(0).alias("end")).union(ends.select("id", F.lit(1).alias("end")))
    paired = marks.withColumn("to_id", F.lead("id").over(Window.orderBy("id", "end"))).where("end = 0")
    return paired.select(F.col("id").alias("from_id"), "to_id", (F.col("to_id") - F.col("id") + 1).alias("n"))


@query(f"""WITH {TRIPS_SQL} SELECT trip, c_name AS customer_name, s_name AS carrier_name, o.n_name AS origin, d.n_name AS dest, r_name AS region FROM trips
LEFT JOIN customer ON c_custkey = customer LEFT JOIN supplier ON s_suppkey = carrier LEFT JOIN nation o ON o.n_nationkey = origin LEFT JOIN nation d ON d.n_nationkey = dest LEFT JOIN region ON r_regionkey = d.n_regionkey""")
def s29_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star view; the sizes of the dimensions decide how they are joined."""
    nation = read(spark, sf_dir, "nation")
    names = lambda key, name, more=(): nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name), *more)
    return (
        trips(spark, sf_dir)
        .join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("customer_name")), "customer", "left")
        .join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("carrier"), F.col("s_name").alias("carrier_name")), "carrier", "left")
        .join(names("origin", "o"), "origin", "left")
        .join(names("dest", "d", [F.col("n_regionkey").alias("r_regionkey")]), "dest", "left")
        .join(read(spark, sf_dir, "region"), "r_regionkey", "left")
        .select("trip", "customer_name", "carrier_name", F.col("o").alias("origin"), F.col("d").alias("dest"), F.col("r_name").alias("region"))
    )


_OLD = "SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS v, 1 AS version FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey AS id, 'U' AS status, o_custkey + 1 AS v, 2 AS version FROM orders WHERE o_orderkey % 5 = 0"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("v"), F.lit(1).alias("version"))
    new = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.lit("U").alias("status"), (F.col("o_custkey") + 1).alias("v"), F.lit(2).alias("version"))
    return old, new


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def k02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.upsert(*_sides(spark, sf_dir), ["id"])


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT id, min(v) AS low, max(v) AS high, sum(version) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY id", whole=("n",))
def k03_span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return old.unionByName(new).groupBy("id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("version").alias("n"))


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def k04_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    return K.upsert(new, old, ["id"])


@query("""WITH known AS (SELECT p_brand AS name, CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS id FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0) x),
fresh AS (SELECT DISTINCT p_type || '/' || p_brand AS name FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT name, id FROM known UNION ALL SELECT name, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name) FROM fresh WHERE name NOT IN (SELECT name FROM known)""")
def k05_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names get the next ids; known ones keep theirs."""
    part = read(spark, sf_dir, "part")
    known = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("name")).distinct().withColumn("id", F.dense_rank().over(Window.orderBy("name")).cast("long"))
    fresh = part.select(F.concat_ws("/", "p_type", "p_brand").alias("name")).union(part.select("p_brand")).distinct()
    return K.with_surrogates(known, fresh, "name", "id")


@query(f"WITH {PINGS_SQL} SELECT event_id FROM pings WHERE us >= (SELECT max(us) FROM pings) - 7 * 24 * {HOUR}")
def k17_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after a purge of all that is older than seven days."""
    df = pings(spark, sf_dir)
    newest = df.agg(F.max("us").alias("newest"))
    return df.join(F.broadcast(newest), F.col("us") >= F.col("newest") - 7 * 24 * HOUR).select("event_id")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def j01_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return read(spark, sf_dir, "orders").join(who, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS trips, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def j03_left_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join with a condition on the right: the right side is filtered first."""
    right = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return read(spark, sf_dir, "customer").join(right, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("trips"), F.max("o_orderdate").alias("latest"))


@query(f"""WITH {PINGS_SQL}, w AS (SELECT vehicle, event_id AS trip, us AS from_us, us + 36 * {HOUR} AS to_us FROM pings)
SELECT w.trip, w.vehicle, count(*) AS fixes, min(p.us) AS first_us, max(p.us) AS last_us FROM w JOIN pings p ON p.vehicle = w.vehicle AND p.us >= from_us AND p.us < to_us GROUP BY ALL""")
def j04_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip's view of its vehicle's series: fixes within the trip's window. Windows are cut into buckets of time."""
    from wayfold.operators.intervals import overlap_join

    df = pings(spark, sf_dir)
    windows = df.select("vehicle", F.col("event_id").alias("trip"), F.col("us").alias("from_us"), (F.col("us") + 36 * HOUR).alias("to_us"))
    fixes = df.select("vehicle", "us", (F.col("us") + 1).alias("us_end"))
    held = overlap_join(windows, fixes, "vehicle", 24 * HOUR, "from_us", "to_us", "us", "us_end")
    return held.groupBy("trip", "vehicle").agg(F.count(F.lit(1)).alias("fixes"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def j05_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return read(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j06_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"""WITH old AS ({_OLD}), new AS ({_NEW}) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS kind FROM old a FULL JOIN new b ON a.id = b.id""")
def j07_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side: only in one, in both and equal, in both and changed."""
    old, new = _sides(spark, sf_dir)
    both = old.select("id", F.col("v").alias("a")).join(new.select("id", F.col("v").alias("b")), "id", "full")
    return both.select("id", F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("kind"))


@query(f"WITH {PINGS_SQL} SELECT vehicle, arg_max(event_type, (us, event_id)) AS last_state, max(us) AS last_us FROM pings GROUP BY vehicle")
def j08_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).groupBy("vehicle").agg(F.max_by("event_type", F.struct("us", "event_id")).alias("last_state"), F.max("us").alias("last_us"))


@query(f"""WITH {PINGS_SQL}, q AS (SELECT event_id, vehicle, us FROM pings WHERE event_type = 'error'), p AS (SELECT vehicle, us, k FROM pings WHERE moving)
SELECT q.event_id, q.vehicle, p.us AS as_of_us, p.k AS as_of_k FROM q ASOF LEFT JOIN p ON q.vehicle = p.vehicle AND q.us >= p.us""")
def j09_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest moving fix at or before each error."""
    df = pings(spark, sf_dir)
    asked = df.where("event_type = 'error'").select("event_id", "vehicle", "us")
    return J.as_of(asked, df.where("moving").select("vehicle", F.col("us").alias("r_us"), "k"), "vehicle", "us", "r_us", ["k"]).select("event_id", "vehicle", "as_of_us", "as_of_k")


@query(f"""WITH {PLACED_SQL}, f AS (SELECT n_nationkey AS fence, 20 + n_nationkey * 0.4::DOUBLE AS lat0, 75 + n_nationkey * 0.2::DOUBLE AS lon0 FROM nation)
SELECT event_id, fence FROM placed, f WHERE lat >= lat0 AND lat < lat0 + 0.3::DOUBLE AND lon >= lon0 AND lon < lon0 + 0.5::DOUBLE""")
def j11_polygon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in polygons: fences are laid out in grid cells, an equi-join on cells precedes the exact test."""
    corner = lambda dy, dx: F.struct((F.col("lat0") + dy).alias("lat"), (F.col("lon0") + dx).alias("lon"))
    fences = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fence"), (20 + F.col("n_nationkey") * F.lit(0.4)).alias("lat0"), (75 + F.col("n_nationkey") * F.lit(0.2)).alias("lon0"))
    fences = fences.withColumn("ring", F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.lit(0.0), F.lit(0.5)), corner(F.lit(0.3), F.lit(0.5)), corner(F.lit(0.3), F.lit(0.0))))
    size = 0.25
    rows = F.sequence(F.floor(F.col("lat0") / size), F.floor((F.col("lat0") + 0.3) / size))
    columns = F.sequence(F.floor(F.col("lon0") / size), F.floor((F.col("lon0") + 0.5) / size))
    spread = fences.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(columns))
    fixes = placed(spark, sf_dir).withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.floor(F.col("lon") / size)})
    return fixes.join(spread, ["cy", "cx"]).where(X.point_in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).select("event_id", "fence")


_CLOSE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2))))"


@query(f"""WITH {PLACED_SQL}, p AS (SELECT n_nationkey AS place, 20 + n_nationkey * 0.37::DOUBLE AS p_lat, 75 + n_nationkey * 0.21::DOUBLE AS p_lon FROM nation),
n AS (SELECT event_id, place, {_CLOSE} AS m FROM placed, p WHERE abs(p_lat - lat) <= 0.2 AND abs(p_lon - lon) <= 0.2)
SELECT event_id, count(*) AS near, arg_min(place, (m, place)) AS nearest FROM n WHERE m <= 15000 GROUP BY event_id""")
def j13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 15 km of each fix, and the nearest."""
    places = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), (20 + F.col("n_nationkey") * F.lit(0.37)).alias("p_lat"), (75 + F.col("n_nationkey") * F.lit(0.21)).alias("p_lon"))
    near = J.radius_join(placed(spark, sf_dir), places, 15_000, 0.2)
    return near.groupBy("event_id").agg(F.count(F.lit(1)).alias("near"), F.min_by("place", F.struct("metres", "place")).alias("nearest"))


@query(f"""WITH {PINGS_SQL}, h AS (SELECT h FROM generate_series(0, 23) AS g(h)), c AS (SELECT (us // {HOUR}) % 24 AS h, count(*) AS n FROM pings GROUP BY ALL)
SELECT CAST(h.h AS BIGINT) AS hour, coalesce(n, 0) AS fixes FROM h LEFT JOIN c ON c.h = h.h""")
def j19_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 24 hours, with nothing where nothing happened."""
    counts = pings(spark, sf_dir).groupBy((F.floor(F.col("us") / HOUR) % 24).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(24).withColumnRenamed("id", "hour").join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("fixes"))


@query(f"""WITH {TRIPS_SQL}, a AS (SELECT CAST(started AS DATE) AS d, count(*) AS started_n FROM trips WHERE started IS NOT NULL GROUP BY ALL), b AS (SELECT CAST(booked AS DATE) AS d, count(*) AS booked_n FROM trips GROUP BY ALL)
SELECT coalesce(a.d, b.d) AS day, coalesce(started_n, 0) AS started_n, coalesce(booked_n, 0) AS booked_n FROM a FULL JOIN b ON a.d = b.d""")
def j20_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trips(spark, sf_dir)
    a = df.where("started is not null").groupBy(F.to_date("started").alias("day")).agg(F.count(F.lit(1)).alias("started_n"))
    b = df.groupBy(F.to_date("booked").alias("day")).agg(F.count(F.lit(1)).alias("booked_n"))
    return a.join(b, "day", "full").select("day", F.coalesce("started_n", F.lit(0)).alias("started_n"), F.coalesce("booked_n", F.lit(0)).alias("booked_n"))


@query(f"""WITH {PINGS_SQL}, p AS (SELECT vehicle FROM pings GROUP BY vehicle ORDER BY max(us) DESC, vehicle LIMIT 20)
SELECT event_id, vehicle, us - lag(us) {_ORDER} AS gap FROM pings WHERE vehicle IN (SELECT vehicle FROM p)""")
def j22_late_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest vehicles first, then the window over their fixes alone: a top-k report."""
    df = pings(spark, sf_dir)
    picked = df.groupBy("vehicle").agg(F.max("us").alias("newest")).orderBy(F.desc("newest"), "vehicle").limit(20).select("vehicle")
    own = df.join(F.broadcast(picked), "vehicle", "left_semi")
    return own.select("event_id", "vehicle", (F.col("us") - F.lag("us").over(Window.partitionBy("vehicle").orderBy("us", "event_id"))).alias("gap"))


@query("""WITH a AS (SELECT p_partkey, upper(trim(p_name)) AS k FROM part), g AS (SELECT upper(trim(p_name)) AS k, min(p_brand) AS brand FROM part WHERE p_size > 25 GROUP BY ALL), d AS (SELECT upper(trim(p_name)) AS k, min(p_type) AS type FROM part GROUP BY ALL)
SELECT p_partkey, coalesce(brand, type) AS resolved, CASE WHEN brand IS NOT NULL THEN 'gazetteer' WHEN type IS NOT NULL THEN 'data' END AS source FROM a LEFT JOIN g ON g.k = a.k LEFT JOIN d ON d.k = a.k""")
def j23_coalescing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that knows a folded name, and which one it was."""
    part = read(spark, sf_dir, "part").withColumn("k", F.upper(F.trim("p_name")))
    g = part.where("p_size > 25").groupBy("k").agg(F.min("p_brand").alias("brand"))
    d = part.groupBy("k").agg(F.min("p_type").alias("type"))
    out = part.join(g, "k", "left").join(d, "k", "left")
    return out.select("p_partkey", F.coalesce("brand", "type").alias("resolved"), F.when(F.col("brand").isNotNull(), "gazetteer").when(F.col("type").isNotNull(), "data").alias("source"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) = o_orderkey")
def j25_cast_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = read(spark, sf_dir, "customer").withColumn("n", F.regexp_extract("c_name", "([0-9]+)", 1).cast("long"))
    return who.join(read(spark, sf_dir, "orders"), F.col("n") == F.col("o_orderkey")).select("c_custkey", "o_orderkey")
