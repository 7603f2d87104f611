"""Congestion scenes over the stays of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import intervals as I
from wayfold.operators import scenes as C
from wayfold.plans.catalogue import query
from wayfold.sources.shared import staged
from wayfold.sources.tables import HOUR, STAYS_SQL, stays
from wayfold.sources.trails import ZONES_SQL, zones

DAY = I.DAY
#: A scene asks for outlines within four times each other's area and this share of the smaller crowd.
RATIO, SHARE = 4.0, 0.02
#: Vehicles at a site from which it is crowded, and the shortest episode.
CROWDED, LEAST_US = 3, 12 * HOUR

_EPISODES_SQL = f"""{STAYS_SQL}, {ZONES_SQL},
e0 AS (SELECT site, enter AS us, 1 AS d FROM stays WHERE enter < leave UNION ALL SELECT site, leave, -1 FROM stays WHERE enter < leave),
e1 AS (SELECT site, us, sum(d) AS d FROM e0 GROUP BY site, us HAVING sum(d) <> 0),
steps AS (SELECT site, us, sum(d) OVER (PARTITION BY site ORDER BY us) AS level, lead(us) OVER (PARTITION BY site ORDER BY us) AS until FROM e1),
f AS (SELECT *, level >= {CROWDED} AND until IS NOT NULL AS "on", lag(level >= {CROWDED}) OVER (PARTITION BY site ORDER BY us) AS was FROM steps),
g AS (SELECT *, sum(CASE WHEN "on" AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY us) AS grp FROM f),
runs AS (SELECT site, min(us) AS start_us, max(until) AS end_us FROM g WHERE "on" GROUP BY site, grp HAVING max(until) - min(us) >= {LEAST_US}),
eps AS (SELECT site * 1000000 + row_number() OVER (PARTITION BY site ORDER BY start_us) AS episode, site // 50 AS plant, site AS zone, start_us, end_us FROM runs),
crowd AS (SELECT DISTINCT episode, vehicle FROM eps JOIN stays s ON s.site = eps.zone AND s.enter < end_us AND start_us < s.leave),
edges AS (SELECT zone, lat6 AS y1, lon6 AS x1, coalesce(lead(lat6) OVER w, first(lat6) OVER w) AS y2, coalesce(lead(lon6) OVER w, first(lon6) OVER w) AS x2
  FROM corners WINDOW w AS (PARTITION BY zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
local AS (SELECT e.*, lats[1] AS oy, lons[1] AS ox FROM edges e JOIN zones USING (zone)),
places AS (
  SELECT zone, abs(CAST(sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) AS BIGINT)) AS area2,
         CAST(round(any_value(oy) + sum(CAST((y1 + y2 - 2 * oy) AS DOUBLE) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / (3 * sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)))) AS BIGINT) AS cy,
         CAST(round(any_value(ox) + sum(CAST((x1 + x2 - 2 * ox) AS DOUBLE) * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))) / (3 * sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)))) AS BIGINT) AS cx
  FROM local WHERE zone IN (SELECT zone FROM eps) GROUP BY zone),
holds AS (
  SELECT p.zone AS inner_zone, e.zone AS outer_zone FROM places p JOIN edges e ON e.zone <> p.zone AND e.zone IN (SELECT zone FROM eps) GROUP BY ALL
  HAVING count(*) FILTER (WHERE (y1 > cy) <> (y2 > cy)
    AND CASE WHEN y2 > y1 THEN (x1 - cx) * (y2 - y1) + (x2 - x1) * (cy - y1) > 0 ELSE (x1 - cx) * (y2 - y1) + (x2 - x1) * (cy - y1) < 0 END) % 2 = 1),
same AS (
  SELECT DISTINCT least(inner_zone, outer_zone) AS zone, greatest(inner_zone, outer_zone) AS other FROM holds h JOIN places a ON a.zone = inner_zone JOIN places b ON b.zone = outer_zone
  WHERE least(a.area2, b.area2) > 0 AND greatest(a.area2, b.area2) <= {RATIO} * least(a.area2, b.area2)),
sizes AS (SELECT episode, count(*) AS n FROM crowd GROUP BY episode),
common AS (
  SELECT a.episode AS a, b.episode AS b, count(*) AS n FROM same s JOIN eps a ON a.zone = s.zone JOIN eps b ON b.zone = s.other AND b.plant = a.plant AND a.start_us < b.end_us AND b.start_us < a.end_us
  JOIN crowd ca ON ca.episode = a.episode JOIN crowd cb ON cb.episode = b.episode AND cb.vehicle = ca.vehicle GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.episode = a JOIN sizes y ON y.episode = b WHERE c.n >= {SHARE} * least(x.n, y.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"""


def crowded_episodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans in which a site is crowded, and who was there then. Sites are those of the zones of the same number."""
    df = stays(spark, sf_dir)
    runs = I.runs_at_least(I.occupancy(df, ["site"]), ["site"], F.lit(CROWDED)).where(F.col("leave") - F.col("enter") >= LEAST_US)
    number = F.row_number().over(Window.partitionBy("site").orderBy("enter"))
    eps = staged(runs.select((F.col("site") * 1_000_000 + number).alias("episode"), F.floor(F.col("site") / 50).alias("plant"), F.col("site").alias("zone"), F.col("enter").alias("start_us"), F.col("leave").alias("end_us")), "episodes")
    met = I.overlap_join(eps, df.select(F.col("site").alias("zone"), "vehicle", "enter", "leave"), "zone", 30 * DAY, "start_us", "end_us", "enter", "leave")
    return eps, staged(met.select("episode", "vehicle").distinct(), "crowds")


@query(f"""WITH RECURSIVE {_EPISODES_SQL},
reach AS (SELECT episode AS a, episode AS b FROM eps UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
scene AS (SELECT a AS episode, min(b) AS scene FROM reach GROUP BY a),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY scene ORDER BY area2, start_us, s.episode) AS rn FROM scene s JOIN eps e ON e.episode = s.episode JOIN places p ON p.zone = e.zone)
SELECT episode, scene, rn = 1 AS "primary" FROM ranked""")
def i19_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded episodes of outlines that draw one place, at one time, with a shared crowd, are one scene; transitive."""
    eps, crowd = crowded_episodes(spark, sf_dir)
    places = staged(zones(spark, sf_dir, eps.select("zone").distinct()), "places")
    return C.scenes(eps, crowd, places, RATIO, SHARE, 30 * DAY)


_LAYOUT_SQL = f"""{ZONES_SQL}, copies AS (SELECT zone AS ground, CASE WHEN zone % 7 = 0 THEN 2 ELSE 1 END + CASE WHEN zone % 21 = 0 THEN 1 ELSE 0 END AS copies FROM zones),
edges AS (SELECT zone, lat6 AS y1, lon6 AS x1, coalesce(lead(lat6) OVER w, first(lat6) OVER w) AS y2, coalesce(lead(lon6) OVER w, first(lon6) OVER w) AS x2, first(lat6) OVER w AS oy, first(lon6) OVER w AS ox
  FROM corners WINDOW w AS (PARTITION BY zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
boxes AS (SELECT zone, min(lat6) AS s, max(lat6) AS n, min(lon6) AS w, max(lon6) AS e FROM corners GROUP BY zone),
t AS (SELECT zone, oy, ox, (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) AS c, y1 + y2 - 2 * oy AS sy, x1 + x2 - 2 * ox AS sx FROM edges),
places AS (SELECT zone, abs(CAST(sum(c) AS BIGINT)) AS area2, CAST(round(any_value(oy) + sum(CAST(sy AS DOUBLE) * c) / (3 * sum(c))) AS BIGINT) AS cy, CAST(round(any_value(ox) + sum(CAST(sx AS DOUBLE) * c) / (3 * sum(c))) AS BIGINT) AS cx FROM t GROUP BY zone),
holds AS (
  SELECT p.zone, e.zone AS outer_zone FROM places p JOIN boxes b ON b.zone <> p.zone AND cy BETWEEN s AND n AND cx BETWEEN w AND b.e JOIN edges e ON e.zone = b.zone GROUP BY ALL
  HAVING count(*) FILTER (WHERE (y1 > cy) <> (y2 > cy)
    AND CASE WHEN y2 > y1 THEN (x1 - cx) * (y2 - y1) + (x2 - x1) * (cy - y1) > 0 ELSE (x1 - cx) * (y2 - y1) + (x2 - x1) * (cy - y1) < 0 END) % 2 = 1),
plants AS (SELECT h.zone, arg_max(outer_zone, (o.area2, -outer_zone)) AS plant FROM holds h JOIN places p ON p.zone = h.zone JOIN places o ON o.zone = outer_zone WHERE o.area2 > p.area2 GROUP BY h.zone)"""


@query(f"WITH {_LAYOUT_SQL} SELECT ground, copies, coalesce(plant, ground) AS plant FROM copies LEFT JOIN plants ON plants.zone = ground", whole=("copies",))
def i21_grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines that were drawn twice or three times under other numbers are one ground each; a ground belongs to the largest one around it."""
    once = zones(spark, sf_dir)
    again = [once.where(F.col("zone") % n == 0).withColumn("zone", F.col("zone") + n * 1_000_000) for n in (7, 21)]
    return C.layout(once.unionByName(again[0]).unionByName(again[1]))
