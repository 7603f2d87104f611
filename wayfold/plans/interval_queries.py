"""Stays: unions, occupancy, episodes, timelines, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import intervals as I
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, STAYS_SQL, stays

DAY = I.DAY
_MERGED = """m0 AS (SELECT *, max(leave) OVER (PARTITION BY site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stays),
m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0),
merged AS (SELECT site, min(enter) AS enter, max(leave) AS leave, count(*) AS n FROM m1 GROUP BY site, grp)"""
_STEPS = """e0 AS (SELECT site, enter AS us, 1 AS d FROM stays WHERE enter < leave UNION ALL SELECT site, leave, -1 FROM stays WHERE enter < leave),
e1 AS (SELECT site, us, sum(d) AS d FROM e0 GROUP BY site, us HAVING sum(d) <> 0),
steps AS (SELECT site, us, CAST(sum(d) OVER (PARTITION BY site ORDER BY us) AS BIGINT) AS level, lead(us) OVER (PARTITION BY site ORDER BY us) AS until FROM e1)"""


@query(f"WITH {STAYS_SQL}, {_MERGED} SELECT * FROM merged")
def i01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the stays at each site."""
    return I.merged(stays(spark, sf_dir), ["site"])


@query(f"""WITH {STAYS_SQL}, m0 AS (SELECT *, max(leave) OVER w AS reach FROM stays WINDOW w AS (PARTITION BY vehicle, site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle, site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0)
SELECT vehicle, site, min(enter) AS enter, max(leave) AS leave, array_to_string(list_sort(list_distinct(list(seq))), ',') AS trips, bool_and(status = 'O') AS open FROM m1 GROUP BY vehicle, site, grp""")
def i02_fold_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a visit fold into one: first entry, last exit, the trips it belongs to; open only if all copies are."""
    order = Window.partitionBy("vehicle", "site").orderBy("enter", "leave")
    df = stays(spark, sf_dir).withColumn("reach", F.max("leave").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("grp", F.sum(F.when(F.col("enter") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy("vehicle", "site", "grp").agg(F.min("enter").alias("enter"), F.max("leave").alias("leave"), F.array_sort(F.collect_set("seq")).alias("t"), F.every(F.col("status") == "O").alias("open"))
    return out.select("vehicle", "site", "enter", "leave", F.array_join(F.col("t").cast("array<string>"), ",").alias("trips"), "open")


def _copies_sql(touching: bool) -> str:
    """Recursive: from each stay of a vehicle to all that links reach. The event is the place of its first stay."""
    less = "<=" if touching else "<"
    return f"""WITH RECURSIVE {STAYS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY enter, leave, seq, site, part) - 1 AS i FROM stays),
link AS (SELECT a.vehicle, a.i AS a, b.i AS b FROM o a JOIN o b ON a.vehicle = b.vehicle AND a.i <> b.i
  WHERE (a.enter = b.enter AND a.leave = b.leave) OR (a.seq <> b.seq AND a.enter {less} b.leave AND b.enter {less} a.leave)),
reach AS (SELECT vehicle, i AS a, i AS b FROM o UNION SELECT r.vehicle, r.a, l.b FROM reach r JOIN link l ON l.vehicle = r.vehicle AND l.a = r.b),
event AS (SELECT vehicle, a AS i, min(b) AS event FROM reach GROUP BY vehicle, a),
found AS (SELECT o.*, event FROM o JOIN event e ON e.vehicle = o.vehicle AND e.i = o.i)"""


def _copies(spark: SparkSession, sf_dir: str, touching: bool) -> DataFrame:
    df = stays(spark, sf_dir).select("vehicle", "site", "seq", "part", "enter", "leave")
    return I.copies(df, "vehicle", "seq", ["seq", "site", "part", "enter", "leave"], touching=touching)


@query(f"{_copies_sql(False)} SELECT vehicle, site, seq, enter, event FROM found")
def i03_strict_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of different lines that strictly overlap are one event, transitively: one sweep per vehicle over its open stays."""
    return _copies(spark, sf_dir, False).select("vehicle", "site", "seq", "enter", "event")


@query(f"""{_copies_sql(True)}, best AS (SELECT *, row_number() OVER (PARTITION BY vehicle, event ORDER BY leave - enter DESC, i) AS rn FROM found)
SELECT vehicle, event, CAST(min(enter) AS BIGINT) AS enter, CAST(max(leave) AS BIGINT) AS leave, max(CASE WHEN rn = 1 THEN site END) AS site,
       array_to_string(list_sort(list_distinct(list(seq))), ',') AS trips FROM best GROUP BY vehicle, event""")
def i04_physical_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a stop, touching ones too, as one: from the first start to the last end, at the place of the longest, with the trips it was seen in."""
    found = _copies(spark, sf_dir, True)
    longest = F.struct(F.col("enter") - F.col("leave"), "enter", "leave", "seq", "site", "part")
    out = found.groupBy("vehicle", "event").agg(F.min("enter").alias("enter"), F.max("leave").alias("leave"), F.min_by("site", longest).alias("site"), F.sort_array(F.collect_set("seq")).alias("t"))
    return out.select("vehicle", "event", "enter", "leave", "site", F.array_join(F.col("t").cast("array<string>"), ",").alias("trips"))


@query(f"{_copies_sql(False)} SELECT vehicle, event, site, seq, enter, leave FROM found WHERE i = event")
def i05_physical_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative row for each event: the first of its copies."""
    found = _copies(spark, sf_dir, False)
    first = F.struct("enter", "leave", "seq", "site", "part")
    one = found.groupBy("vehicle", "event").agg(F.min(first).alias("x"))
    return one.select("vehicle", "event", "x.site", "x.seq", "x.enter", "x.leave")


@query(f"""WITH {STAYS_SQL}, m0 AS (SELECT *, max(leave) OVER (PARTITION BY vehicle ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stays),
m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0),
u AS (SELECT vehicle, max(leave) - min(enter) AS span FROM m1 GROUP BY vehicle, grp) SELECT vehicle, CAST(sum(span) AS BIGINT) AS at_sites_us, count(*) AS places FROM u GROUP BY vehicle""")
def i06_time_at_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time at any site: nested and overlapping stays count once."""
    df = stays(spark, sf_dir).select("vehicle", "enter", "leave")
    spans = I.merged(df.repartition(I.parts(df), "vehicle"), ["vehicle"])
    return spans.groupBy("vehicle").agg(F.sum(F.col("leave") - F.col("enter")).alias("at_sites_us"), F.count(F.lit(1)).alias("places"))


@query(f"""WITH {STAYS_SQL}, l AS (SELECT vehicle, enter, leave, seq AS priority, flag AS kind FROM stays),
c AS (SELECT DISTINCT vehicle, us FROM (SELECT vehicle, enter AS us FROM l UNION ALL SELECT vehicle, leave FROM l)),
a AS (SELECT vehicle, us, lead(us) OVER (PARTITION BY vehicle ORDER BY us) AS until FROM c),
t AS (SELECT a.vehicle, us, until, arg_max(kind, (priority, kind)) AS kind FROM a JOIN l ON l.vehicle = a.vehicle AND l.enter <= us AND until <= l.leave GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(until) OVER w = us THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY vehicle ORDER BY us)),
g AS (SELECT *, sum(new) OVER (PARTITION BY vehicle ORDER BY us) AS grp FROM n)
SELECT vehicle, kind, min(us) AS enter, max(until) AS leave FROM g GROUP BY vehicle, grp, kind""")
def i08_painted_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline per vehicle on which later lines paint over earlier ones."""
    layers = stays(spark, sf_dir).select("vehicle", "enter", "leave", F.col("seq").alias("priority"), F.col("flag").alias("kind"))
    return I.painted(layers, "vehicle")


@query(f"WITH {STAYS_SQL}, {_STEPS} SELECT site, us, level, until FROM steps")
def i13_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vehicles are at each site, as a step function."""
    return I.occupancy(stays(spark, sf_dir), ["site"]).select("site", "us", "level", "until")


@query(f"WITH {STAYS_SQL}, {_STEPS} SELECT site, level, CAST(sum(until - us) AS BIGINT) AS at_level_us FROM steps WHERE level > 0 AND until IS NOT NULL GROUP BY site, level")
def i14_level_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.level_time(I.occupancy(stays(spark, sf_dir), ["site"]), ["site"])


@query(f"""WITH {STAYS_SQL}, {_STEPS}, f AS (SELECT *, level >= 3 AND until IS NOT NULL AS "on", lag(level >= 3) OVER (PARTITION BY site ORDER BY us) AS was FROM steps),
g AS (SELECT *, sum(CASE WHEN "on" AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY us) AS grp FROM f)
SELECT site, min(us) AS enter, max(until) AS leave, max(level) AS peak FROM g WHERE "on" GROUP BY site, grp""")
def i15_crowded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in which three vehicles or more are at a site."""
    return I.runs_at_least(I.occupancy(stays(spark, sf_dir), ["site"]), ["site"], F.lit(3))


@query(f"""WITH {STAYS_SQL}, {_STEPS}, t AS (SELECT site, level, sum(until - us) AS w FROM steps WHERE level > 0 AND until IS NOT NULL GROUP BY site, level),
c AS (SELECT *, sum(w) OVER (PARTITION BY site ORDER BY level) AS so_far, sum(w) OVER (PARTITION BY site) AS total FROM t),
u AS (SELECT site, min(level) AS usual FROM c WHERE so_far >= total * 0.9 GROUP BY site),
m AS (SELECT site, median(leave - enter) AS stay_us, count(*) AS stays FROM stays GROUP BY site)
SELECT m.site, usual, stay_us, stays, usual + greatest(1, CAST(ceil(usual * 0.2::DOUBLE) AS BIGINT)) AS threshold, stays < 20 AS thin FROM m LEFT JOIN u ON u.site = m.site""")
def i16_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual level (busy time weighted, 90 %), the median stay and the threshold that follows."""
    df = stays(spark, sf_dir)
    usual = I.weighted_percentile(I.level_time(I.occupancy(df, ["site"]), ["site"]), ["site"], "level", "at_level_us", 0.9)
    facts = df.groupBy("site").agg(F.median(F.col("leave") - F.col("enter")).alias("stay_us"), F.count(F.lit(1)).alias("stays"))
    out = facts.join(usual.withColumnRenamed("level", "usual"), "site", "left")
    return out.withColumns({"threshold": F.col("usual") + F.greatest(F.lit(1).cast("long"), F.ceil(F.col("usual") * F.lit(0.2))), "thin": F.col("stays") < 20})


@query(f"""WITH {STAYS_SQL}, {_STEPS}, f AS (SELECT *, level >= 3 AND until IS NOT NULL AS "on", lag(level >= 3) OVER (PARTITION BY site ORDER BY us) AS was FROM steps),
g AS (SELECT *, sum(CASE WHEN "on" AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY us) AS grp FROM f),
r AS (SELECT site, min(us) AS enter, max(until) AS leave, max(level) AS peak FROM g WHERE "on" GROUP BY site, grp),
n AS (SELECT *, CASE WHEN enter - max(leave) OVER (PARTITION BY site ORDER BY enter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {48 * HOUR} THEN 0 ELSE 1 END AS new FROM r),
h AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY enter) AS ep FROM n),
e AS (SELECT site, min(enter) AS ep_enter, max(leave) AS ep_leave, max(peak) AS peak FROM h GROUP BY site, ep HAVING max(leave) - min(enter) >= {12 * HOUR})
SELECT e.site, ep_enter, ep_leave, peak, count(*) AS present, count(*) FILTER (WHERE s.enter >= ep_enter) AS arrived FROM e JOIN stays s ON s.site = e.site AND s.enter < ep_leave AND ep_enter < s.leave GROUP BY ALL""")
def i18_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Congestion episodes: crowded runs joined over short breaks, short ones dropped, with who was present and who arrived."""
    df = stays(spark, sf_dir)
    runs = I.runs_at_least(I.occupancy(df, ["site"]), ["site"], F.lit(3))
    order = Window.partitionBy("site").orderBy("enter")
    reach = F.max("leave").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("enter") - reach <= 48 * HOUR, 0).otherwise(1))
    runs = runs.withColumn("ep", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    eps = runs.groupBy("site", "ep").agg(F.min("enter").alias("ep_enter"), F.max("leave").alias("ep_leave"), F.max("peak").alias("peak"))
    eps = eps.where(F.col("ep_leave") - F.col("ep_enter") >= 12 * HOUR).drop("ep")
    seen = I.overlap_join(eps, df.select("site", "enter", "leave"), "site", 30 * DAY, "ep_enter", "ep_leave", "enter", "leave")
    return seen.groupBy("site", "ep_enter", "ep_leave", "peak").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("enter") >= F.col("ep_enter")).alias("arrived"))


@query(f"""WITH {STAYS_SQL}, s AS (SELECT DISTINCT site, d * {DAY} AS at_us FROM stays, generate_series(10000, 11200, 30) AS g(d))
SELECT s.site, at_us, count(*) AS inside, min(vehicle) AS a_vehicle FROM s JOIN stays t ON t.site = s.site AND t.enter <= at_us AND at_us < t.leave GROUP BY ALL""")
def i23_inside_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is inside at sampled times: a spine of times joined to the stays that hold them."""
    df = stays(spark, sf_dir)
    spine = df.select("site").distinct().withColumn("d", F.explode(F.sequence(F.lit(10000), F.lit(11200), F.lit(30)))).select("site", (F.col("d") * F.lit(DAY)).alias("at_us"))
    spine = spine.withColumn("at_end", F.col("at_us") + 1)
    hits = I.overlap_join(spine, df.select("site", "vehicle", "enter", "leave"), "site", 7 * DAY, "at_us", "at_end", "enter", "leave")
    return hits.groupBy("site", "at_us").agg(F.count(F.lit(1)).alias("inside"), F.min("vehicle").alias("a_vehicle"))


@query(f"""WITH {STAYS_SQL}, m0 AS (SELECT *, max(leave) OVER (PARTITION BY site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM stays),
m1 AS (SELECT *, sum(CASE WHEN enter <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY enter, leave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM m0)
SELECT site, vehicle, seq, part FROM m1 SEMI JOIN (SELECT DISTINCT site, grp FROM m1 WHERE part % 50 = 0) t USING (site, grp)""")
def i27_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stays that chain-overlap a changed one: what an incremental refresh has to look at again."""
    order = Window.partitionBy("site").orderBy("enter", "leave")
    df = stays(spark, sf_dir).withColumn("reach", F.max("leave").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("grp", F.sum(F.when(F.col("enter") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(df.where("part % 50 = 0").select("site", "grp").distinct(), ["site", "grp"], "left_semi").select("site", "vehicle", "seq", "part")


@query(f"""WITH {STAYS_SQL}, d AS (SELECT *, unnest(generate_series(enter // {DAY}, greatest(enter, leave - 1) // {DAY})) AS day FROM stays)
SELECT site, day, count(*) AS visits, CAST(sum(least(leave, (day + 1) * {DAY}) - greatest(enter, day * {DAY})) AS BIGINT) AS dwell_us, count(DISTINCT vehicle) AS vehicles FROM d GROUP BY site, day""")
def a61_day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and dwell per site and day, dwell split at midnight."""
    days = I.split_by_day(stays(spark, sf_dir))
    return days.groupBy("site", "day").agg(F.count(F.lit(1)).alias("visits"), F.sum("in_day_us").alias("dwell_us"), F.countDistinct("vehicle").alias("vehicles"))


@query(f"""WITH {STAYS_SQL}, e AS (SELECT vehicle AS alert, vehicle % 100 AS site, min(enter) + {HOUR} AS at_us FROM stays WHERE flag = 'R' GROUP BY vehicle),
o AS (SELECT alert, at_us, e.site, s.vehicle AS owner, s.enter AS owner_enter, row_number() OVER (PARTITION BY alert ORDER BY s.enter, s.vehicle, s.seq, s.part) AS rn FROM e JOIN stays s ON s.site = e.site AND s.enter <= at_us AND at_us < s.leave)
SELECT alert, at_us, site, owner, owner_enter FROM o WHERE rn = 1""")
def j15_event_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alert belongs to the first stay at its site that holds it."""
    df = stays(spark, sf_dir)
    alerts = df.where("flag = 'R'").groupBy("vehicle").agg((F.min("enter") + HOUR).alias("at_us")).select(F.col("vehicle").alias("alert"), (F.col("vehicle") % 100).alias("site"), "at_us", (F.col("at_us") + 1).alias("at_end"))
    held = I.overlap_join(alerts, df.select("site", F.col("vehicle").alias("owner"), "enter", "leave", "seq", "part"), "site", 30 * DAY, "at_us", "at_end", "enter", "leave")
    rank = F.row_number().over(Window.partitionBy("alert").orderBy("enter", "owner", "seq", "part"))
    return held.withColumn("rn", rank).where("rn = 1").select("alert", "at_us", "site", "owner", F.col("enter").alias("owner_enter"))


@query(f"""WITH {STAYS_SQL} SELECT a.vehicle, a.seq, a.part, a.site FROM stays a WHERE NOT EXISTS (SELECT 1 FROM stays b WHERE b.vehicle = a.vehicle AND b.enter < a.leave AND a.enter < b.leave AND (b.cost, b.seq, b.part, b.site) < (a.cost, a.seq, a.part, a.site))""")
def j17_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of overlapping stays of a vehicle the one in the smallest zone (here: the cheapest) is primary."""
    df = stays(spark, sf_dir).select("vehicle", "seq", "part", "site", "cost", "enter", "leave")
    other = df.select("vehicle", F.struct("cost", "seq", "part", "site").alias("b"), F.col("enter").alias("b_enter"), F.col("leave").alias("b_leave"))
    own = df.withColumn("a", F.struct("cost", "seq", "part", "site"))
    smaller = (own["vehicle"] == other["vehicle"]) & (F.col("b_enter") < F.col("leave")) & (F.col("enter") < F.col("b_leave")) & (F.col("b") < F.col("a"))
    return own.join(other, smaller, "left_anti").select("vehicle", "seq", "part", "site")
