"""Trails against a master of zones: containment, visits, the innermost of nested ones, violations, summaries, live detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars as X
from wayfold.operators import tiles as T
from wayfold.operators import zones as Z
from wayfold.operators.rings import crossed, inscribed
from wayfold.operators.scenes import centroids
from wayfold.operators.silences import moving_silences, passages
from wayfold.plans.catalogue import query
from wayfold.sources.shared import shared_folder, staged
from wayfold.sources.tables import HOUR
from wayfold.sources.trails import TRAILS_SQL, ZONES_SQL, trails, zones
from wayfold.streaming.detector import detected
from wayfold.streaming.runs import in_slices, to_the_end

#: Fixes of the tables are hours apart, so what takes minutes in a fleet takes hours here.
CONFIRM_US, ESCAPE, SILENCE_US = 8 * HOUR, 1_000.0, 36 * HOUR

_INSIDE_SQL = f"""{TRAILS_SQL}, {ZONES_SQL}, edges AS (
  SELECT zone, lat6 AS y1, lon6 AS x1, coalesce(lead(lat6) OVER w, first(lat6) OVER w) AS y2, coalesce(lead(lon6) OVER w, first(lon6) OVER w) AS x2
  FROM corners WINDOW w AS (PARTITION BY zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
boxes AS (SELECT zone, min(lat6) AS s, max(lat6) AS n, min(lon6) AS w, max(lon6) AS e FROM corners GROUP BY zone),
inside AS (
  SELECT event_id, vehicle, us, t.lat6, t.lon6, b.zone
  FROM trails t JOIN boxes b ON t.lat6 BETWEEN s AND n AND t.lon6 BETWEEN w AND e JOIN edges g ON g.zone = b.zone
  GROUP BY ALL HAVING count(*) FILTER (WHERE (y1 > t.lat6) <> (y2 > t.lat6)
    AND CASE WHEN y2 > y1 THEN (x1 - t.lon6) * (y2 - y1) + (x2 - x1) * (t.lat6 - y1) > 0 ELSE (x1 - t.lon6) * (y2 - y1) + (x2 - x1) * (t.lat6 - y1) < 0 END) % 2 = 1)"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.visits(trails(spark, sf_dir), zones(spark, sf_dir), CONFIRM_US, ESCAPE, SILENCE_US)


@query(f"WITH {_INSIDE_SQL} SELECT event_id, zone FROM inside")
def j11_fixes_in_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fix in every zone that holds it: tiles and boxes, then exact outlines."""
    return T.containing(trails(spark, sf_dir), zones(spark, sf_dir))


@query(f"""WITH {_INSIDE_SQL}, areas AS (SELECT zone, abs(CAST(sum(x1 * y2 - x2 * y1) AS HUGEINT)) AS area2 FROM edges GROUP BY zone),
ranked AS (SELECT event_id, i.zone, count(*) OVER (PARTITION BY event_id) AS zones, row_number() OVER (PARTITION BY event_id ORDER BY area2, i.zone) AS rn FROM inside i JOIN areas a ON a.zone = i.zone)
SELECT event_id, zone, zones FROM ranked WHERE rn = 1""")
def t07_innermost_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest zone that holds a fix, and how many do."""
    return T.innermost(trails(spark, sf_dir), zones(spark, sf_dir), count=True).select("event_id", "zone", "zones")


@query()
def m07_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of every trail to every zone, with what happened in them; of nested ones the innermost is primary."""
    found = Z.with_primary(_visits(spark, sf_dir), zones(spark, sf_dir))
    return found.withColumn("metres", F.round("metres", 3))


@query()
def m07_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of restricted zones, and the worst fix of each visit over the limit."""
    return Z.violations(_visits(spark, sf_dir), zones(spark, sf_dir))


@query()
def m07_trail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trail. The walk over the zones runs once for visits and violations alike."""
    return Z.summed_up(trails(spark, sf_dir), Z.breaches_of(_visits(spark, sf_dir), zones(spark, sf_dir)), SILENCE_US)


@query()
def t03_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings and alerts of all zones from a stream of all fixes, run to its end; the batch below gives the same rows."""
    # A slice is one file and so one task, which must not sort all trails again.
    fixes, master = staged(trails(spark, sf_dir), "trails"), zones(spark, sf_dir)
    source = shared_folder(spark, "fixes")
    in_slices(fixes, "us", 4, source)
    found = to_the_end(spark, source, fixes.schema, lambda s: detected(s, master, CONFIRM_US, ESCAPE, SILENCE_US), "live-events")
    return found.select("vehicle", "zone", "kind", "us")


@query()
def m07_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by batch: one ordered walk per vehicle and zone, those of a tile side by side."""
    return T.events(trails(spark, sf_dir), zones(spark, sf_dir), CONFIRM_US, ESCAPE, SILENCE_US)


_CROSSED_SQL = f"""{ZONES_SQL}, swapped AS (
  SELECT zone, CASE WHEN zone % 3 = 0 AND i = 1 THEN 3 WHEN zone % 3 = 0 AND i = 3 THEN 1 ELSE i END AS i, lat6, lon6, count(*) OVER (PARTITION BY zone) AS n FROM corners),
edges AS (SELECT a.zone, a.i, a.n, a.lon6 AS x1, a.lat6 AS y1, b.lon6 AS x2, b.lat6 AS y2 FROM swapped a JOIN swapped b ON b.zone = a.zone AND b.i = (a.i + 1) % a.n),
pairs AS (SELECT e.zone, e.i AS a, f.i AS b,
    sign((e.x2 - e.x1) * (f.y1 - e.y1) - (e.y2 - e.y1) * (f.x1 - e.x1)) * sign((e.x2 - e.x1) * (f.y2 - e.y1) - (e.y2 - e.y1) * (f.x2 - e.x1)) AS s,
    sign((f.x2 - f.x1) * (e.y1 - f.y1) - (f.y2 - f.y1) * (e.x1 - f.x1)) * sign((f.x2 - f.x1) * (e.y2 - f.y1) - (f.y2 - f.y1) * (e.x2 - f.x1)) AS t
  FROM edges e JOIN edges f ON f.zone = e.zone AND f.i > e.i + 1 AND NOT (e.i = 0 AND f.i = e.n - 1)),
first_pair AS (SELECT zone, a, b FROM pairs WHERE s < 0 AND t < 0 QUALIFY row_number() OVER (PARTITION BY zone ORDER BY a, b) = 1)"""


def _swapped(zones_: DataFrame) -> DataFrame:
    """Outlines, every third with its second and fourth corner in each other's place, as careless drawing leaves them."""
    place = lambda i: F.when((F.col("zone") % 3 == 0) & (i == 1), 3).when((F.col("zone") % 3 == 0) & (i == 3), 1).otherwise(i)
    moved = lambda c: F.transform(F.col(c), lambda _, i: F.get(F.col(c), place(i)))
    return zones_.select("zone", moved("lats").alias("lats"), moved("lons").alias("lons"))


@query(f"WITH {_CROSSED_SQL} SELECT z.zone, CAST(a AS INTEGER) AS crossing_a, CAST(b AS INTEGER) AS crossing_b FROM zones z LEFT JOIN first_pair p ON p.zone = z.zone")
def g08_crossing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two edges of each outline that cross; none in a proper one."""
    return crossed(_swapped(zones(spark, sf_dir)))


@query()
def g09_inscribed_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius of the largest circle in each outline, to half a metre, and the band that follows from it."""
    found = inscribed(zones(spark, sf_dir), 5_000.0)
    return found.select("zone", F.round("inradius_m", 2).alias("inradius_m"), F.round(X.adaptive_band(F.col("inradius_m")), 3).alias("band"))


@query()
def m16_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that vehicles may have passed in their silences of a day or more. Without a router the route is the straight leg at 0.004 m/s, the pace of these trails."""
    gaps = moving_silences(trails(spark, sf_dir), 24 * HOUR, 300.0)
    routed = gaps.withColumns({"route_m": F.col("straight_m"), "route_s": F.col("straight_m") / 0.004})
    found = passages(routed, zones(spark, sf_dir), _visits(spark, sf_dir), unexplained_s=12 * 3_600.0)
    return found.withColumns({c: F.round(c, 2) for c in ("inside_m", "nearest_m")})


_INNERMOST_SQL = f"""{_INSIDE_SQL}, areas AS (SELECT zone, abs(CAST(sum(x1 * y2 - x2 * y1) AS HUGEINT)) AS area2 FROM edges GROUP BY zone),
innermost AS (SELECT event_id, arg_min(i.zone, (area2, i.zone)) AS innermost FROM inside i JOIN areas a ON a.zone = i.zone GROUP BY event_id)"""


def _innermost(spark: SparkSession, sf_dir: str, fixes: DataFrame) -> DataFrame:
    """(event_id, innermost) of the fixes that a zone holds."""
    return T.innermost(fixes, zones(spark, sf_dir)).select("event_id", F.col("zone").alias("innermost"))


@query(f"""WITH {_INNERMOST_SQL}, l AS (SELECT vehicle, max(us) AS us, arg_max(event_id, (us, event_id)) AS event_id FROM trails GROUP BY vehicle)
SELECT vehicle, us, innermost FROM l LEFT JOIN innermost USING (event_id)""")
def t07_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last position of each vehicle with the innermost zone around it."""
    df = trails(spark, sf_dir)
    newest = F.max_by(F.struct("us", "event_id", "lat6", "lon6", "speed"), F.struct("us", "event_id"))
    last = df.groupBy("vehicle").agg(newest.alias("x")).select("vehicle", "x.*")
    return last.join(_innermost(spark, sf_dir, last), "event_id", "left").select("vehicle", "us", "innermost")


@query(f"WITH {_INNERMOST_SQL} SELECT event_id, innermost FROM trails LEFT JOIN innermost USING (event_id) WHERE speed < 3000")
def c32_facility_of_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost zone at each slow fix."""
    slow = trails(spark, sf_dir).where("speed < 3000")
    return slow.select("event_id").join(_innermost(spark, sf_dir, slow), "event_id", "left")


@query(f"""WITH {_INNERMOST_SQL}, legs AS (SELECT e.*, first(lat6) OVER (PARTITION BY e.zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0 FROM edges e JOIN (SELECT zone, i, lat6, lon6 FROM corners) c ON c.zone = e.zone AND c.lat6 = e.y1 AND c.lon6 = e.x1),
near AS (
  SELECT event_id, g.zone, (x1 - t.lon6) * {Z.METRE6!r}::DOUBLE * cos(radians(y0 * 1e-6)) AS ax, (y1 - t.lat6) * {Z.METRE6!r}::DOUBLE AS ay, (x2 - x1) * {Z.METRE6!r}::DOUBLE * cos(radians(y0 * 1e-6)) AS ex, (y2 - y1) * {Z.METRE6!r}::DOUBLE AS ey
  FROM trails t JOIN boxes b ON t.lat6 BETWEEN s - 20000 AND n + 20000 AND t.lon6 BETWEEN w - 20000 AND e + 20000 JOIN legs g ON g.zone = b.zone),
along AS (SELECT *, greatest(0, least(1, -(ax * ex + ay * ey) / (ex * ex + ey * ey))) AS u FROM near),
closest AS (SELECT event_id, zone, min(sqrt(pow(ax + u * ex, 2) + pow(ay + u * ey, 2))) AS metres FROM along GROUP BY ALL HAVING min(sqrt(pow(ax + u * ex, 2) + pow(ay + u * ey, 2))) < 1500),
best AS (SELECT event_id, arg_min(zone, (metres, zone)) AS nearest FROM closest GROUP BY event_id)
SELECT event_id, coalesce(innermost, nearest) AS region, innermost IS NULL AS outside FROM trails LEFT JOIN innermost USING (event_id) LEFT JOIN best USING (event_id)""")
def g12_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost zone of a fix, else the nearest one within 1,500 m by the distance to its edge."""
    df = trails(spark, sf_dir)
    best = T.regions(df, zones(spark, sf_dir), 1_500.0)
    return df.select("event_id").join(best, "event_id", "left").select("event_id", F.coalesce("inside", "nearest").alias("region"), F.col("inside").isNull().alias("outside"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as arrays of corners in degrees."""
    corners = F.transform(F.sequence(F.lit(0), F.size("lats") - 1), lambda i: F.struct((F.get("lats", i) / 1e6).alias("lat"), (F.get("lons", i) / 1e6).alias("lon")))
    return zones(spark, sf_dir).select("zone", "lats", "lons", corners.alias("ring"))


@query(f"""WITH {ZONES_SQL}, p AS (SELECT zone, i, lat6 / 1e6::DOUBLE AS lat, lon6 / 1e6::DOUBLE AS lon FROM corners), f AS (SELECT zone, lat || '' AS a, lon || '' AS b FROM p WHERE i = 0)
SELECT p.zone, 'POLYGON((' || string_agg(p.lon || ' ' || p.lat, ', ' ORDER BY i) || ', ' || any_value(f.b) || ' ' || any_value(f.a) || '))' AS wkt FROM p JOIN f ON f.zone = p.zone GROUP BY p.zone""")
def g04_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as text: corners that repeat the one before them go, the ring is closed."""
    doubled = F.flatten(F.transform("ring", lambda p: F.array(p, p)))
    return _rings(spark, sf_dir).select("zone", X.ring_wkt(doubled).alias("wkt"))


@query(f"""WITH {ZONES_SQL}, edges AS (SELECT zone, i, lat6 / 1e6::DOUBLE AS y1, lon6 / 1e6::DOUBLE AS x1, coalesce(lead(lat6) OVER w, first(lat6) OVER w) / 1e6::DOUBLE AS y2, coalesce(lead(lon6) OVER w, first(lon6) OVER w) / 1e6::DOUBLE AS x2
  FROM corners WINDOW w AS (PARTITION BY zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
probes AS (SELECT zone, 'corner' AS probe, lats[1] / 1e6::DOUBLE AS lat, lons[1] / 1e6::DOUBLE AS lon FROM zones UNION ALL SELECT zone, 'middle', (lats[1] + lats[3]) / 2e6::DOUBLE, (lons[1] + lons[3]) / 2e6::DOUBLE FROM zones
  UNION ALL SELECT zone, 'aside', lats[1] / 1e6::DOUBLE + 0.01::DOUBLE, lons[1] / 1e6::DOUBLE FROM zones)
SELECT p.zone, probe, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 AS hit FROM probes p JOIN edges e ON e.zone = p.zone GROUP BY p.zone, probe, lat, lon""")
def g05_point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open containment as an array expression: a corner, a point between corners and one beside, against every outline."""
    lat, lon = (lambda i: F.get("lats", F.lit(i))), (lambda i: F.get("lons", F.lit(i)))
    point = lambda name, a, b: F.struct(F.lit(name).alias("probe"), a.alias("lat"), b.alias("lon"))
    probes = F.array(point("corner", lat(0) / 1e6, lon(0) / 1e6), point("middle", (lat(0) + lat(2)) / 2e6, (lon(0) + lon(2)) / 2e6), point("aside", lat(0) / 1e6 + F.lit(0.01), lon(0) / 1e6))
    df = _rings(spark, sf_dir).select("zone", "ring", F.explode(probes).alias("p"))
    return df.select("zone", "p.probe", X.point_in_ring(F.col("p.lat"), F.col("p.lon"), F.col("ring")).alias("hit"))


@query(f"""WITH {ZONES_SQL}, edges AS (SELECT zone, lat6 AS y1, lon6 AS x1, coalesce(lead(lat6) OVER w, first(lat6) OVER w) AS y2, coalesce(lead(lon6) OVER w, first(lon6) OVER w) AS x2, first(lat6) OVER w AS oy, first(lon6) OVER w AS ox
  FROM corners WINDOW w AS (PARTITION BY zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT zone, oy, ox, (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) AS c, y1 + y2 - 2 * oy AS sy, x1 + x2 - 2 * ox AS sx,
         {Z.METRE6!r}::DOUBLE * sqrt(pow(y2 - y1, 2) + pow((x2 - x1) * cos(radians(oy * 1e-6)), 2)) AS metres FROM edges)
SELECT zone, abs(CAST(sum(c) AS BIGINT)) AS area2, sum(c) > 0 AS counter_clockwise, CAST(floor(sum(metres) / 10 + 0.5) AS BIGINT) AS perimeter_10m,
       CAST(round(any_value(oy) + sum(CAST(sy AS DOUBLE) * c) / (3 * sum(c))) AS BIGINT) AS lat6, CAST(round(any_value(ox) + sum(CAST(sx AS DOUBLE) * c) / (3 * sum(c))) AS BIGINT) AS lon6 FROM t GROUP BY zone""")
def g07_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, direction, perimeter and centre of every outline."""
    df = centroids(zones(spark, sf_dir))
    n, at = F.size("lats"), lambda c, i: F.get(F.col(c), i)
    wide = F.cos(F.radians(F.get("lats", F.lit(0)) * 1e-6))
    edge = lambda i, j: F.sqrt(F.pow(at("lats", j) - at("lats", i), F.lit(2)) + F.pow((at("lons", j) - at("lons", i)) * wide, F.lit(2)))
    perimeter = Z.METRE6 * F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(i, (i + 1) % n)), F.lit(0.0), lambda a, b: a + b)
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((at("lats", i) - at("lats", F.lit(0))).alias("lat"), (at("lons", i) - at("lons", F.lit(0))).alias("lon")))
    return df.select("zone", "area2", (X.ring_area(ring) > 0).alias("counter_clockwise"), F.floor(perimeter / 10 + 0.5).alias("perimeter_10m"), "lat6", "lon6")


@query(f"WITH {ZONES_SQL} SELECT category, max(band) AS widest_band, CAST(ceil((max(band) + {ESCAPE}::DOUBLE) / {Z.METRE6!r}::DOUBLE) AS BIGINT) AS pad6 FROM zones GROUP BY category")
def c57_largest_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far outside a zone of each category a fix may still matter, in metres and micro-degrees: the padding of searches."""
    pad = F.ceil((F.max("band") + ESCAPE) / Z.METRE6)
    return zones(spark, sf_dir).groupBy("category").agg(F.max("band").alias("widest_band"), pad.cast("long").alias("pad6"))


@query(f"""WITH {TRAILS_SQL}, n AS (SELECT vehicle, row_number() OVER w AS pos, first(lat6) OVER w AS y0, first(lon6) OVER w AS x0, lat6, lon6 FROM trails WINDOW w AS (PARTITION BY vehicle ORDER BY us, event_id)),
d AS (SELECT vehicle, pos, 2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians((lat6 - y0) / 1e6::DOUBLE) / 2), 2) + cos(radians(y0 / 1e6::DOUBLE)) * cos(radians(lat6 / 1e6::DOUBLE)) * pow(sin(radians((lon6 - x0) / 1e6::DOUBLE) / 2), 2))) AS metres FROM n),
f AS (SELECT vehicle, max(pos) FILTER (WHERE metres <= 1500) AS departs, count(*) AS n FROM d GROUP BY vehicle)
SELECT vehicle, departs, departs AS at_origin, n - departs AS on_the_way FROM f""")
def m14_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fix within 1,500 m of where a trail begins, and how many lie before and after it."""
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    df = trails(spark, sf_dir).select("vehicle", F.row_number().over(w).cast("long").alias("pos"), *[(F.col(c) / 1e6).alias(c) for c in ("lat6", "lon6")], *[(F.first(c).over(w) / 1e6).alias(f"{c}_0") for c in ("lat6", "lon6")])
    metres = X.haversine_m(F.col("lat6_0"), F.col("lon6_0"), F.col("lat6"), F.col("lon6"))
    found = df.groupBy("vehicle").agg(F.max(F.when(metres <= 1_500, F.col("pos"))).alias("departs"), F.count(F.lit(1)).alias("n"))
    return found.select("vehicle", "departs", F.col("departs").alias("at_origin"), (F.col("n") - F.col("departs")).alias("on_the_way"))
