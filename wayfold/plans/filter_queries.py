"""Projections, predicates, sorts, sets and small joins as requests use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import predicates as P
from wayfold.functions import scalars as X
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, PLACED_SQL, STAYS_SQL, TRIPS_SQL, pings, placed, read, stays, trips


@query("SELECT o_orderkey AS trip, o_custkey AS customer, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders")
def p01_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("customer"), F.round(F.col("o_totalprice") * 100).cast("long").alias("price"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def p04_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(P.in_days(F.col("o_orderdate"), "1996-02-01", "1996-02-29")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40")
def p05_optional_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that were not asked for are left out of the conjunction."""
    wanted = {"l_returnflag": "R", "l_linestatus": None}
    tests = [F.col(c) == v if v is not None else None for c, v in wanted.items()]
    return read(spark, sf_dir, "lineitem").where(P.all_of(*tests, F.col("l_quantity") >= 40)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH r AS (SELECT o_orderpriority AS priority, CASE WHEN grouping(o_custkey) = 1 THEN 0 ELSE o_custkey + 1 END AS scope, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_custkey), (o_orderpriority))) SELECT * FROM r WHERE scope = 0 OR scope = 7""")
def p06_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup holds one row a customer and one for all; a request reads either."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.explode(F.array(F.col("o_custkey") + 1, F.lit(0).cast("long"))).alias("scope"))
    rollup = orders.groupBy("priority", "scope").agg(F.count(F.lit(1)).alias("n"))
    return rollup.where(P.scoped(F.col("scope"), None) | P.scoped(F.col("scope"), 7))


@query(f"WITH {TRIPS_SQL} SELECT trip, CASE WHEN origin = dest THEN 'local' ELSE 'zonal' END AS class FROM trips WHERE origin = dest")
def p07_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips within one nation are local, the others zonal; 'all' filters nothing."""
    kind = F.when(F.col("origin") == F.col("dest"), "local").otherwise("zonal")
    df = trips(spark, sf_dir).select("trip", kind.alias("class"))
    return df.where(P.of_class(F.col("class"), "local") & P.of_class(F.col("class"), "all"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[0-9]+$') AND regexp_matches(p_name, '[aeiou]{2}')")
def p10_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(F.col("p_brand").rlike("^Brand#[0-9]+$") & F.col("p_name").rlike("[aeiou]{2}")).select("p_partkey")


@query(f"""WITH {TRIPS_SQL}, t AS (SELECT trip, CASE on_time WHEN 1 THEN 'on time' WHEN 0 THEN 'late' END AS verdict FROM trips)
SELECT trip, verdict FROM t WHERE verdict IS NULL UNION ALL SELECT trip, verdict FROM t WHERE verdict = 'late'""")
def p12_unknown_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("on_time") == 1, "on time").when(F.col("on_time") == 0, "late")
    df = trips(spark, sf_dir).select("trip", verdict.alias("verdict"))
    return df.where(P.equals_label(F.col("verdict"), P.UNKNOWN) | P.equals_label(F.col("verdict"), "late"))


@query("""WITH s AS (SELECT l_suppkey AS site, string_agg(DISTINCT l_returnflag, ',') AS flags FROM lineitem GROUP BY l_suppkey)
SELECT site FROM s WHERE list_contains(string_split(flags, ','), 'R')""")
def p15_find_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in a comma-separated list."""
    lists = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))
    return lists.where(F.find_in_set(F.lit("R"), F.col("flags")) > 0).select("site")


@query(f"""WITH {TRIPS_SQL} SELECT 'late' AS preset, count(*) AS n FROM trips WHERE on_time = 0 UNION ALL SELECT 'long', count(*) FROM trips WHERE days > 60
UNION ALL SELECT 'unjudged', count(*) FROM trips WHERE on_time IS NULL""")
def p16_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named predicates of a dataset, counted in one pass."""
    presets = {"late": F.col("on_time") == 0, "long": F.col("days") > 60, "unjudged": F.col("on_time").isNull()}
    counts = trips(spark, sf_dir).agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in presets.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(n).alias("n")) for n in presets])).alias("x")).select("x.*")


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * p_size * p_size * 100 AS area FROM part)
SELECT p_partkey, CASE WHEN area < 10000 THEN 'micro' WHEN area < 1000000 THEN 'site' WHEN area < 10000000 THEN 'campus' ELSE 'regional' END AS scale FROM p""")
def p19_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", P.scale_of(size * size * size * 100).alias("scale"))


@query("""SELECT p_partkey, CASE WHEN p_size * 100 <= 2000 AND regexp_matches(lower(p_type), 'brass|steel') THEN 'workshop'
 WHEN p_size * 100 <= 2000 AND regexp_matches(lower(p_type), 'copper|tin') THEN 'store' END AS hint FROM part""")
def p22_amenity_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands near by its name, if it is near enough."""
    near, name = F.col("p_size") * 100 <= 2000, F.lower("p_type")
    return read(spark, sf_dir, "part").select("p_partkey", F.when(near & name.rlike("brass|steel"), "workshop").when(near & name.rlike("copper|tin"), "store").alias("hint"))


@query(f"""WITH {PLACED_SQL}, q AS (SELECT event_id, CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 95 ELSE lat END AS lat, CASE k % 11 WHEN 1 THEN 0 ELSE lon END AS lon FROM placed)
SELECT event_id, CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing' WHEN abs(lat) < 0.01 AND abs(lon) < 0.01 THEN 'zero island'
 WHEN lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN 'out of range' END AS reason FROM q""")
def p23_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("k") % 11
    df = placed(spark, sf_dir).withColumn("lat", F.when(i == 0, None).when(i == 1, 0.0).when(i == 2, 95.0).otherwise(F.col("lat"))).withColumn("lon", F.when(i == 1, 0.0).otherwise(F.col("lon")))
    return df.select("event_id", P.implausible(F.col("lat"), F.col("lon")).alias("reason"))


@query(f"WITH {PINGS_SQL} SELECT count(*) FILTER (WHERE speed > 6000) AS over_default, count(*) FILTER (WHERE speed > 5000) AS over_chosen FROM pings")
def p24_snapped_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that is not offered (55) is read as the default, an offered one (50) as it is."""
    return pings(spark, sf_dir).agg(*[F.count_if(F.col("speed") > P.snapped(v) * 100).alias(n) for v, n in ((55, "over_default"), (50, "over_chosen"))])


@query(f"WITH {TRIPS_SQL} SELECT trip, days FROM trips ORDER BY days DESC NULLS LAST, trip LIMIT 50")
def p25_order_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = {"days": F.col("days"), "price": F.col("price")}
    return trips(spark, sf_dir).orderBy(P.ordering("days; drop table", "desc", allowed, "days"), "trip").select("trip", "days").limit(50)


@query(f"""WITH {STAYS_SQL}, m AS (SELECT *, status = 'F' AND flag <> 'N' AND leave > enter AS measured FROM stays)
SELECT site, count(*) FILTER (WHERE measured) AS measured, count(*) AS stays, sum(leave - enter) FILTER (WHERE measured) AS inside_us FROM m GROUP BY site""", whole=("inside_us",))
def p26_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only stays that are closed and whose ends were both seen are measured."""
    measured = (F.col("status") == "F") & (F.col("flag") != "N") & (F.col("leave") > F.col("enter"))
    df = stays(spark, sf_dir).withColumn("measured", measured)
    span = F.sum(F.when(F.col("measured"), F.col("leave") - F.col("enter")))
    return df.groupBy("site").agg(F.count_if("measured").alias("measured"), F.count(F.lit(1)).alias("stays"), span.alias("inside_us"))


@query("""SELECT c_custkey, n_name, r_name, count(o_orderkey) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def j02_left_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders stay; orders are counted before the join."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    star = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    star = star.join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(orders, "c_custkey", "left")
    return star.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"))


_ZONES = [(0, "depot", 20.5, 75.6, 30_000), (1, "yard", 22.3, 77.4, 60_000), (2, "port", 27.0, 79.0, 45_000), (3, "new depot", 20.6, 75.8, 50_000)]
_ZONES_SQL = "zones(id, name, zlat, zlon, radius) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', {a}::DOUBLE, {o}::DOUBLE, {r}::DOUBLE)" for i, n, a, o, r in _ZONES) + ")"
_METRES = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(zlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(zlat)) * pow(sin(radians(zlon - lon) / 2), 2))))"


def _zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, a, o, float(r)) for i, n, a, o, r in _ZONES], "id long, name string, zlat double, zlon double, radius double")


def _in_zones(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Every zone of a small literal list around each position; a box is tried before the distance."""
    pad = F.col("radius") / 111_000 * 1.2
    box = F.abs(F.col("lat") - F.col("zlat")) <= pad
    met = X.haversine_m(F.col("lat"), F.col("lon"), F.col("zlat"), F.col("zlon"))
    return df.join(F.broadcast(_zones(spark)), box).withColumn("metres", met).where(F.col("metres") <= F.col("radius"))


@query(f"""WITH {PLACED_SQL}, {_ZONES_SQL}, m AS (SELECT event_id, id, name, {_METRES} AS metres, radius FROM placed, zones)
SELECT event_id, arg_max(name, id) AS label FROM m WHERE metres <= radius GROUP BY event_id""")
def j14_newest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labels within reach the newest."""
    return _in_zones(spark, placed(spark, sf_dir)).groupBy("event_id").agg(F.max_by("name", "id").alias("label"))


@query(f"""WITH {PLACED_SQL}, {_ZONES_SQL}, m AS (SELECT event_id, id, {_METRES} AS metres, radius FROM placed, zones)
SELECT event_id, list(id ORDER BY id)::VARCHAR AS ids FROM m WHERE metres <= radius GROUP BY event_id""")
def c46_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones that hold each posted point."""
    ids = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ", "), F.lit("]"))
    return _in_zones(spark, placed(spark, sf_dir)).groupBy("event_id").agg(ids.alias("ids"))


@query(f"""WITH {PLACED_SQL}, {_ZONES_SQL}, m AS (SELECT event_id, CASE WHEN id = 0 THEN 1 WHEN id = 1 THEN 2 ELSE 3 END AS rank, {_METRES} AS metres, radius FROM placed, zones WHERE NOT moving),
b AS (SELECT event_id, min(rank) AS rank FROM m WHERE metres <= radius GROUP BY event_id)
SELECT event_id, CASE rank WHEN 1 THEN 'origin' WHEN 2 THEN 'destination' WHEN 3 THEN 'named_node' ELSE 'unclassified' END AS mask FROM pings LEFT JOIN b USING (event_id) WHERE NOT moving""")
def g19_stop_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing fixes near an origin, else near a destination, else near a named node."""
    still = placed(spark, sf_dir).where("not moving")
    rank = F.when(F.col("id") == 0, 1).when(F.col("id") == 1, 2).otherwise(3)
    best = _in_zones(spark, still).groupBy("event_id").agg(F.min(rank).alias("rank"))
    mask = F.when(F.col("rank") == 1, "origin").when(F.col("rank") == 2, "destination").when(F.col("rank") == 3, "named_node").otherwise("unclassified")
    return still.select("event_id").join(best, "event_id", "left").select("event_id", mask.alias("mask"))


@query("""WITH boxes AS (SELECT p_partkey AS id, p_partkey % 50 AS x0, p_partkey % 50 + p_size % 9 + 1 AS x1, p_size AS y0, p_size + p_partkey % 4 + 1 AS y1 FROM part)
SELECT a.id AS inner_id, b.id AS outer_id FROM boxes a JOIN boxes b ON a.id <> b.id AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1""")
def j18_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that lie within others. Different boxes meet in the unit cell where the inner one begins, never all with all; zones then join the boxes they draw.

    No side is broadcast: by the size of their file Spark would take cells and zones to be few.
    """
    i, size = F.col("p_partkey"), F.col("p_size")
    box = ["x0", "x1", "y0", "y1"]
    boxes = read(spark, sf_dir, "part").select(i.alias("id"), (i % 50).alias("x0"), (i % 50 + size % 9 + 1).alias("x1"), size.alias("y0"), (size + i % 4 + 1).alias("y1"))
    drawn = boxes.select(*box).distinct()
    outer = drawn.select(*[F.col(c).alias(f"o{c}") for c in box])
    outer = outer.withColumn("cx", F.explode(F.sequence(F.col("ox0"), F.col("ox1")))).withColumn("cy", F.explode(F.sequence(F.col("oy0"), F.col("oy1"))))
    met = drawn.join(outer.hint("merge"), (F.col("x0") == F.col("cx")) & (F.col("y0") == F.col("cy"))).where("x0 >= ox0 and x1 <= ox1 and y0 >= oy0 and y1 <= oy1")
    inner = met.drop("cx", "cy").join(boxes.withColumnRenamed("id", "inner_id").hint("merge"), box)
    around = boxes.select(F.col("id").alias("outer_id"), *[F.col(c).alias(f"o{c}") for c in box])
    return inner.join(around.hint("merge"), [f"o{c}" for c in box]).where("inner_id <> outer_id").select("inner_id", "outer_id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status FROM orders")
def j21_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal map is a lookup without a join."""
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.element_at(names, F.col("o_orderstatus")), F.lit("unknown")).alias("status"))


@query(f"""WITH {TRIPS_SQL}, share AS (SELECT l_orderkey AS trip, count(DISTINCT l_suppkey) AS sites FROM lineitem GROUP BY 1),
phase AS (SELECT l_orderkey AS trip, count(*) FILTER (WHERE l_linestatus = 'F') AS closed FROM lineitem GROUP BY 1)
SELECT trip, status, sites, closed, c_mktsegment AS segment FROM trips LEFT JOIN share USING (trip) LEFT JOIN phase USING (trip) LEFT JOIN customer ON c_custkey = customer""")
def j26_view_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of a trip; the two over lines share one pass."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.countDistinct("l_suppkey").alias("sites"), F.count_if(F.col("l_linestatus") == "F").alias("closed"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_orderstatus").alias("status"), "o_custkey")
    who = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return orders.join(lines, "trip", "left").join(who, "o_custkey", "left").select("trip", "status", "sites", "closed", "segment")


@query(f"WITH {TRIPS_SQL} SELECT trip, on_time, row_number() OVER (ORDER BY on_time NULLS LAST, trip) AS pos FROM trips QUALIFY pos <= 40")
def l03_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = trips(spark, sf_dir).orderBy(F.col("on_time").asc_nulls_last(), "trip").select("trip", "on_time").limit(40)
    return first.withColumn("pos", F.row_number().over(Window.orderBy(F.col("on_time").asc_nulls_last(), "trip")).cast("long"))


@query(f"WITH {PINGS_SQL} SELECT event_id, speed - 4000 AS off FROM pings ORDER BY abs(speed - 4000) DESC, event_id LIMIT 30")
def l04_by_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).select("event_id", (F.col("speed") - 4000).alias("off")).orderBy(F.abs("off").desc(), "event_id").limit(30)


@query("""WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 5)
SELECT l_suppkey AS site, l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT * FROM top) GROUP BY ALL""")
def l06_rows_of_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the five largest groups: their keys are few and broadcast."""
    lines = read(spark, sf_dir, "lineitem")
    top = lines.groupBy("l_suppkey").count().orderBy(F.desc("count"), "l_suppkey").limit(5).select("l_suppkey")
    return lines.join(F.broadcast(top), "l_suppkey", "left_semi").groupBy(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 30) SELECT day, n FROM d ORDER BY day""")
def l07_latest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest thirty days, oldest first."""
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.desc("day")).limit(30).orderBy("day")


@query(f"""WITH {PINGS_SQL}, a AS (SELECT event_id, us, CASE WHEN speed > 8000 THEN 'high' WHEN speed > 6000 THEN 'medium' ELSE 'low' END AS severity FROM pings)
SELECT event_id, severity FROM a ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, us DESC, event_id LIMIT 60""")
def l08_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("speed") > 8000, "high").when(F.col("speed") > 6000, "medium").otherwise("low")
    rank = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("severity"))
    return pings(spark, sf_dir).withColumn("severity", severity).orderBy(rank, F.desc("us"), "event_id").select("event_id", "severity").limit(60)


@query(f"""WITH {PINGS_SQL}, r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR) || ':7'), event_id) AS pos FROM pings)
SELECT event_type, event_id FROM r WHERE pos <= 25""")
def l10_fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 rows a group, the same ones on every run: those with the least seeded hash. Tasks keep 25 a group before the shuffle."""
    draw = F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7")))
    w = Window.partitionBy("event_type").orderBy("draw", "event_id")
    return pings(spark, sf_dir).withColumn("draw", draw).withColumn("at", F.row_number().over(w)).where("at <= 25").select("event_type", "event_id")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_discount > 0.09)
SELECT part, CASE WHEN b.part IS NULL THEN 'only_a' WHEN a.part IS NULL THEN 'only_b' ELSE 'matched' END AS side FROM a FULL JOIN b USING (part)""")
def u05_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one set, the other or both, by one aggregation instead of an outer join."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_returnflag") == "R").alias("a"), (F.col("l_discount") > 0.09).alias("b")).where("a or b")
    sides = lines.groupBy("part").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return sides.select("part", F.when(~F.col("b"), "only_a").when(~F.col("a"), "only_b").otherwise("matched").alias("side"))


@query("""SELECT DISTINCT site, day FROM (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity = 50)""")
def u06_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two changes touched, together."""
    lines = read(spark, sf_dir, "lineitem")
    touch = lambda df: df.select(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("day"))
    return touch(lines.where("l_returnflag = 'R'")).union(touch(lines.where("l_quantity = 50"))).distinct()


@query("SELECT p_partkey, CAST(p_size * 1000 AS BIGINT) AS whole, CAST(p_size AS DOUBLE) / 2 AS share, CAST(NULL AS BIGINT) AS bad FROM part")
def f02_tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separators and percent signs are ignored; what is no number is null."""
    size = F.col("p_size")
    whole, share = F.concat(F.lit(" "), size.cast("string"), F.lit(",000")), F.concat((size / 2).cast("string"), F.lit("%"))
    return read(spark, sf_dir, "part").select("p_partkey", X.parsed_int(whole).alias("whole"), X.parsed_float(share).alias("share"), X.parsed_int(F.lit("n/a")).alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * (o_orderkey % 5 * 1440 + o_orderkey % 24 * 60 + o_orderkey % 60) AS delta FROM orders")
def f04_delivery_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    clock = F.format_string("%d Days %02d:%02d", i % 5, i % 24, i % 60)
    text = F.concat(F.when(i % 2 == 0, "Before By ").otherwise("Delayed By "), clock)
    return read(spark, sf_dir, "orders").select("o_orderkey", X.delivery_delta_minutes(text).alias("delta"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status FROM orders")
def f06_status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes are spelt out; what is no code stays."""
    return read(spark, sf_dir, "orders").select("o_orderkey", X.spelt_out(F.col("o_orderstatus"), {"F": "Finished", "O": "Open"}).alias("status"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS moving, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INTEGER) END AS speed FROM part")
def f07_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey") % 3
    text = F.when(i == 0, F.concat(F.lit("Vehicle MOVING "), F.col("p_size").cast("string"), F.lit(" km/h"))).when(i == 1, "stopped since 3 h").otherwise("no signal")
    return read(spark, sf_dir, "part").select("p_partkey", X.status_moving(text).alias("moving"), X.status_speed(text).alias("speed"))


@query("SELECT lower(p_type) AS kind, count(*) AS n FROM part GROUP BY 1")
def f08_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ in case and white space alone are one."""
    spread = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), F.regexp_replace(F.upper("p_type"), " ", "  "))).otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").groupBy(X.folded(spread).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, upper(trim(p_brand)) AS brand, split_part(p_brand, '#', 1) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, p_name || '/' || p_type AS full_name FROM part""")
def f09_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(F.trim("p_brand")).alias("brand"),
        F.substring_index("p_brand", "#", 1).alias("head"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.concat_ws("/", "p_name", "p_type").alias("full_name"),
    )


@query("SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n FROM orders GROUP BY 1")
def f11_iso_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(X.iso_week(F.col("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PINGS_SQL} SELECT us // 1800000000 * 1800000000 AS slot_us, count(*) AS n FROM pings GROUP BY 1")
def f12_half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).groupBy((F.floor(F.col("us") / (HOUR // 2)) * (HOUR // 2)).alias("slot_us")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CAST(floor(100 * ln(1 + p_size) + 0.5) AS BIGINT) AS squash, CAST(ceil(p_size / 7.0::DOUBLE) AS BIGINT) AS up, CAST(greatest(p_size, 10) AS BIGINT) AS least_ten, abs(p_size - 25) AS off,
CAST(p_size AS DOUBLE) * p_size AS square FROM part""")
def f13_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.floor(100 * F.log1p(size) + 0.5).alias("squash"), F.ceil(size / 7).alias("up"),
        F.greatest(size, F.lit(10).cast("long")).alias("least_ten"), F.abs(size - 25).alias("off"), F.pow(size.cast("double"), 2).alias("square"),
    )


@query("SELECT p_partkey, CAST(floor(p_size / 2.0::DOUBLE + 0.5) AS BIGINT) AS half_up, CAST(round_even(p_size / 2.0::DOUBLE, 0) AS BIGINT) AS half_even FROM part")
def f14_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes are rounded half up, percentiles half to even."""
    half = F.col("p_size") / 2
    return read(spark, sf_dir, "part").select("p_partkey", F.round(half).cast("long").alias("half_up"), F.bround(half).cast("long").alias("half_even"))


@query(f"WITH {PINGS_SQL} SELECT event_id, coalesce(nullif(k % 3, 0), nullif(speed % 5, 0), -1) AS known, CASE WHEN k > 90 THEN NULL ELSE k END AS sane FROM pings")
def f15_null_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.coalesce(F.nullif(F.col("k") % 3, F.lit(0)), F.nullif(F.col("speed") % 5, F.lit(0)), F.lit(-1).cast("long"))
    return pings(spark, sf_dir).select("event_id", known.alias("known"), F.when(F.col("k") <= 90, F.col("k")).alias("sane"))


@query(f"WITH {TRIPS_SQL} SELECT trip, CASE WHEN days > 0 THEN days END AS days, CASE WHEN price BETWEEN 100000 AND 30000000 THEN price END AS price FROM trips")
def f16_sane_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be is unknown, not zero."""
    return trips(spark, sf_dir).select("trip", X.positive(F.col("days")).alias("days"), F.when(F.col("price").between(100_000, 30_000_000), F.col("price")).alias("price"))


@query(f"""WITH {TRIPS_SQL} SELECT trip, CASE WHEN on_time IS NOT NULL THEN on_time WHEN days - 60 < 0 THEN 1 WHEN days - 60 >= 0 THEN 0 END AS on_time FROM trips""")
def f17_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed says, else the sign of the delay."""
    return trips(spark, sf_dir).select("trip", X.on_time_flag(F.col("on_time"), F.col("days") - 60).alias("on_time"))


@query(f"""WITH {TRIPS_SQL}, m AS (SELECT trip, date_diff('hour', booked, ended) AS total_h, qty FROM trips)
SELECT trip, total_h, CASE WHEN total_h > 0 THEN qty * 1000 // total_h END AS pace, CASE WHEN total_h IS NULL THEN 'unknown' WHEN total_h <= 1440 THEN 'met' WHEN total_h <= 1920 THEN 'late' ELSE 'very late' END AS outcome FROM m""", whole=("pace",))
def f18_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a journey, its pace and whether it met its promise."""
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", "booked"), F.date_trunc("hour", "ended"))
    df = trips(spark, sf_dir).withColumn("total_h", hours)
    outcome = F.when(F.col("total_h").isNull(), "unknown").when(F.col("total_h") <= 1440, "met").when(F.col("total_h") <= 1920, "late").otherwise("very late")
    return df.select("trip", "total_h", F.when(F.col("total_h") > 0, F.floor(F.col("qty") * 1000 / F.col("total_h"))).alias("pace"), outcome.alias("outcome"))


@query(f"WITH {TRIPS_SQL} SELECT trip, CAST(origin AS VARCHAR) || ' > ' || coalesce(CAST(dest AS VARCHAR), '?') AS lane, concat_ws('|', CAST(carrier AS VARCHAR), status) AS site FROM trips")
def f19_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = F.concat(F.col("origin").cast("string"), F.lit(" > "), F.coalesce(F.col("dest").cast("string"), F.lit("?")))
    return trips(spark, sf_dir).select("trip", lane.alias("lane"), F.concat_ws("|", F.col("carrier").cast("string"), "status").alias("site"))


@query("""WITH p AS (SELECT l_orderkey AS trip, l_partkey AS part FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY part) AS pos, count(*) OVER (PARTITION BY trip) AS n FROM p)
SELECT trip, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) FILTER (WHERE pos <= 3) || CASE WHEN any_value(n) > 3 THEN ',...' ELSE '' END AS parts, any_value(n) AS n FROM r GROUP BY trip""")
def f21_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ids of a trip in order, the first three as text."""
    ids = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.sort_array(F.collect_set("l_partkey")).alias("ids"))
    text = F.concat(F.array_join(F.slice("ids", 1, 3).cast("array<string>"), ","), F.when(F.size("ids") > 3, ",...").otherwise(""))
    return ids.select("trip", text.alias("parts"), F.size("ids").cast("long").alias("n"))


@query(f"""WITH {PINGS_SQL} SELECT event_id, CASE WHEN k >= 95 THEN 'storm' WHEN k >= 80 OR speed % 10 = 9 THEN 'rain' WHEN k BETWEEN 45 AND 48 THEN 'fog' WHEN speed >= 9000 THEN 'wind' ELSE 'clear' END AS bucket FROM pings""")
def f22_weather_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes first, then amounts, then wind; the first rule wins."""
    k, s = F.col("k"), F.col("speed")
    bucket = F.when(k >= 95, "storm").when((k >= 80) | (s % 10 == 9), "rain").when(k.between(45, 48), "fog").when(s >= 9000, "wind").otherwise("clear")
    return pings(spark, sf_dir).select("event_id", bucket.alias("bucket"))


@query(f"WITH {TRIPS_SQL} SELECT trip, qty * 9000 // 400 AS fuel_cents, days * 70000 AS driver_cents, qty * 9000 // 400 + days * 70000 AS total_cents FROM trips", whole=("fuel_cents", "total_cents"))
def f24_cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance over mileage at a price, and days at a wage."""
    fuel, driver = F.floor(F.col("qty") * 9000 / 400), F.col("days") * 70_000
    return trips(spark, sf_dir).select("trip", fuel.alias("fuel_cents"), driver.alias("driver_cents"), (fuel + driver).alias("total_cents"))


@query("SELECT p_partkey, CAST(CAST(p_size AS DECIMAL(18, 3)) / 8 AS DECIMAL(11, 2)) AS q FROM part")
def f25_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals of a fixed scale, rounded half up."""
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("decimal(18,3)") / 8).cast("decimal(11,2)").alias("q"))


@query("SELECT l_suppkey AS site, md5(string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus)) AS signature FROM lineitem GROUP BY 1")
def f26_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's signature does not depend on the order of its members."""
    members = F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus")))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.md5(F.array_join(members, ",")).alias("signature"))
