"""Projections, predicates and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import scalars as X
from wayfold.plans.catalogue import query
from wayfold.sources.tables import PINGS_SQL, PLACED_SQL, STAYS_SQL, pings, placed, read, stays


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN '--' WHEN 2 THEN '  ' || p_name || ' ' ELSE p_brand END AS raw, p_type FROM part),
c AS (SELECT p_partkey, CASE WHEN lower(trim(raw)) IN ('', '-', '--', 'na', 'n/a', 'nan', 'none', 'null', 'nil') THEN NULL ELSE trim(raw) END AS cleaned, p_type FROM s)
SELECT p_partkey, cleaned, coalesce(cleaned, trim(p_type)) AS known FROM c""")
def p03_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand for no value become null; the first known of alternatives is taken."""
    i = F.col("p_partkey") % 5
    raw = F.when(i == 0, " N/A ").when(i == 1, "--").when(i == 2, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", X.cleaned(raw).alias("cleaned"), X.first_known(raw, F.col("p_type")).alias("known"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01' AND o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p08_filter_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive days as a half-open range, and a conjunction of optional choices."""
    chosen = {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": []}
    tests = [F.col(c).isin(v) for c, v in chosen.items() if v] + [F.col("o_orderdate") >= "1997-03-01", F.col("o_orderdate") < F.date_add(F.lit("1997-05-31"), 1)]
    return read(spark, sf_dir, "orders").where(reduce(lambda a, b: a & b, tests)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%promo%' OR p_brand ~ 'Brand#[12]$'")
def p09_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(F.lower("p_name").contains("red") | F.lower("p_type").contains("promo") | F.col("p_brand").rlike("Brand#[12]$")).select("p_partkey")


@query(f"WITH {PINGS_SQL}, s AS (SELECT event_id, nullif(k % 4, 0) AS a, nullif(speed % 4, 0) AS b FROM pings) SELECT event_id FROM s WHERE a IS NOT DISTINCT FROM b")
def p11_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.nullif(F.col("k") % 4, F.lit(0)), F.nullif(F.col("speed") % 4, F.lit(0))
    return pings(spark, sf_dir).where(a.eqNullSafe(b)).select("event_id")


@query(f"WITH {STAYS_SQL} SELECT site, vehicle, seq, part FROM stays WHERE enter < 883612800000000 + 5 * 86400000000 AND leave > 883612800000000")
def p13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays that overlap a window; the longest stay bounds the start, so scans can skip what lies before."""
    a, b, longest = 883612800000000, 883612800000000 + 5 * 86400000000, 60 * 3600000000
    return stays(spark, sf_dir).where((F.col("enter") < b) & (F.col("leave") > a) & (F.col("enter") >= a - longest)).select("site", "vehicle", "seq", "part")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O')) AND l_discount > 0.08")
def p14_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair is one of a list of pairs: a semi-join on two keys with a literal table."""
    pairs = spark.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return read(spark, sf_dir, "lineitem").where("l_discount > 0.08").join(F.broadcast(pairs), ["l_returnflag", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH {PLACED_SQL} SELECT event_id, CASE WHEN pow((lat - 21) / 0.4::DOUBLE, 2) + pow((lon - 76) / 0.6::DOUBLE, 2) <= 1 OR pow((lat - 24) / 0.3::DOUBLE, 2) + pow((lon - 78) / 0.3::DOUBLE, 2) <= 1 THEN 'plant' ELSE 'road' END AS zone FROM placed""")
def p17_ellipse_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipses in degrees are a cheap test for plants."""
    inside = lambda lat, lon, a, b: F.pow((F.col("lat") - lat) / a, 2) + F.pow((F.col("lon") - lon) / b, 2) <= 1
    return placed(spark, sf_dir).select("event_id", F.when(inside(21, 76, 0.4, 0.6) | inside(24, 78, 0.3, 0.3), "plant").otherwise("road").alias("zone"))


@query(f"WITH {PINGS_SQL} SELECT event_id, CASE WHEN speed < 500 THEN 'idle' WHEN speed < 3000 THEN 'slow' WHEN speed < 6000 THEN 'cruise' ELSE 'fast' END AS band, CASE WHEN k < 10 THEN 'micro' WHEN k < 50 THEN 'site' WHEN k < 90 THEN 'campus' ELSE 'regional' END AS scale FROM pings")
def p18_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("speed"), F.col("k")
    band = F.when(s < 500, "idle").when(s < 3000, "slow").when(s < 6000, "cruise").otherwise("fast")
    return pings(spark, sf_dir).select("event_id", band.alias("band"), F.when(k < 10, "micro").when(k < 50, "site").when(k < 90, "campus").otherwise("regional").alias("scale"))


_RULES = [("hot", ["RED", "ORANGE"]), ("cold", ["BLUE", "GREEN"]), ("small", ["SMALL", "TINY"])]


@query("""SELECT p_partkey, CASE WHEN upper(p_name) LIKE '%RED%' OR upper(p_name) LIKE '%ORANGE%' THEN 'hot' WHEN upper(p_name) LIKE '%BLUE%' OR upper(p_name) LIKE '%GREEN%' THEN 'cold' WHEN upper(p_name) LIKE '%SMALL%' OR upper(p_name) LIKE '%TINY%' THEN 'small' ELSE 'other' END AS kind,
 CASE WHEN upper(p_name) ~ '(^|[^A-Z0-9])(RED|ORANGE)($|[^A-Z0-9])' THEN 'hot' WHEN upper(p_name) ~ '(^|[^A-Z0-9])(BLUE|GREEN)($|[^A-Z0-9])' THEN 'cold' WHEN upper(p_name) ~ '(^|[^A-Z0-9])(SMALL|TINY)($|[^A-Z0-9])' THEN 'small' ELSE 'other' END AS word_kind FROM part""")
def p20_keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keyword rules, anywhere in a text and on whole words."""
    return read(spark, sf_dir, "part").select("p_partkey", X.first_rule(F.col("p_name"), _RULES, "other").alias("kind"), X.first_word_rule(F.col("p_name"), _RULES, "other").alias("word_kind"))


_TEXTS = ["1 Days 05:36", "14:29", "1 Day 4 Hours 16 Minutes 12 Seconds", "Before By 1 Days 18:24", "Delayed By 02:10", "-", "3 Hours"]
_MINUTES = [1776, 869, 1696, 2544, 130, None, 180]
_DELTAS = [1776, 869, 1696, -2544, 130, None, 180]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {m if m is not None else 'CAST(NULL AS BIGINT)'}, {d if d is not None else 'CAST(NULL AS BIGINT)'})" for i, (m, d) in enumerate(zip(_MINUTES, _DELTAS))) + ") AS t(i, minutes, delta)")
def f03_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration texts of feeds, as minutes; early deliveries count down."""
    rows = spark.createDataFrame(list(enumerate(_TEXTS)), "i int, text string")
    return rows.select("i", X.duration_minutes(F.col("text")).alias("minutes"), X.delivery_delta_minutes(F.col("text")).alias("delta"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ( C' || CAST(p_partkey % 100 AS VARCHAR) || ' ) ' WHEN 1 THEN p_name || ' (north)' ELSE p_name END AS party, CASE p_partkey % 2 WHEN 0 THEN 'Moving ' || CAST(p_size AS VARCHAR) || ' km/h' ELSE 'Stopped' END AS status, CAST(p_size * 1000 AS VARCHAR) || ',5%' AS num FROM part)
SELECT p_partkey, trim(regexp_replace(party, '\\(\\s*[A-Za-z]*\\d[A-Za-z0-9]*\\s*\\)\\s*$', '')) AS name, nullif(regexp_extract(party, '\\(\\s*([A-Za-z]*\\d[A-Za-z0-9]*)\\s*\\)\\s*$', 1), '') AS code,
 CASE WHEN status LIKE 'Moving%' THEN 1 ELSE 0 END AS moving, CAST(nullif(regexp_extract(status, '(\\d+)', 1), '') AS INTEGER) AS speed, CAST(regexp_replace(num, '[,%]', '', 'g') AS DOUBLE) AS num FROM t""")
def f05_feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes behind names, status texts, numbers with separators."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    party = F.when(i % 3 == 0, F.concat("p_name", F.lit(" ( C"), (i % 100).cast("string"), F.lit(" ) "))).when(i % 3 == 1, F.concat("p_name", F.lit(" (north)"))).otherwise(F.col("p_name"))
    status = F.when(i % 2 == 0, F.concat(F.lit("Moving "), size, F.lit(" km/h"))).otherwise("Stopped")
    num = F.concat((F.col("p_size") * 1000).cast("string"), F.lit(",5%"))
    return read(spark, sf_dir, "part").select("p_partkey", X.party_name(party).alias("name"), X.party_code(party).alias("code"), X.status_moving(status).alias("moving"), X.status_speed(status).alias("speed"), X.parsed_float(num).alias("num"))


@query("""SELECT o_orderkey, o_orderdate AS a, o_orderdate AS b, CAST(o_orderdate AS DATE) AS c FROM orders""")
def f01_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps in several formats come back as they were."""
    d = F.col("o_orderdate")
    parse = lambda f: X.parsed_timestamp(F.date_format(d, f))
    return read(spark, sf_dir, "orders").select("o_orderkey", parse("dd/MM/yyyy HH:mm:ss").alias("a"), parse("yyyy-MM-dd'T'HH:mm:ss").alias("b"), F.to_date(parse("dd-MM-yyyy")).alias("c"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, extract('isodow' FROM o_orderdate) - 1 AS weekday, CAST(extract('dow' FROM o_orderdate) + 1 AS BIGINT) AS dow, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN extract('isodow' FROM o_orderdate) >= 6 THEN 1 ELSE 0 END AS weekend FROM orders""")
def f10_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", X.iso_week(d).alias("week"), F.weekday(d).cast("long").alias("weekday"), F.dayofweek(d).cast("long").alias("dow"), F.date_format(d, "yyyy-MM").alias("month"), (F.weekday(d) >= 5).cast("int").alias("weekend"))


@query(f"""WITH {PLACED_SQL}, l AS (SELECT event_id, lat, lon, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM placed WINDOW w AS (PARTITION BY vehicle ORDER BY us, event_id))
SELECT event_id, CAST(floor(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2)))) / 10 + 0.5) AS BIGINT) AS tens FROM l""")
def g01_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle legs of a trail, in tens of metres."""
    from pyspark.sql import Window

    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    df = placed(spark, sf_dir).select("event_id", "lat", "lon", F.lag("lat").over(w).alias("p_lat"), F.lag("lon").over(w).alias("p_lon"))
    return df.select("event_id", F.floor(X.haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) / 10 + 0.5).alias("tens"))
