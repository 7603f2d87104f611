"""Ordered series: gaps, episodes, stops, visits, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import sequences as S
from wayfold.plans.catalogue import query
from wayfold.sources.tables import HOUR, PINGS_SQL, pings

_W = "OVER (PARTITION BY vehicle ORDER BY us, event_id)"
_ROWS = "OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ORDER = ["us", "event_id"]
SILENCE, CAP = 12 * HOUR, 6 * HOUR


@query(f"WITH {PINGS_SQL} SELECT event_id, vehicle, least(coalesce(us - lag(us) {_W}, 0), {CAP}) AS gap_us FROM pings")
def w01_gap_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix is credited with the time since the fix before it, capped."""
    return S.with_gap(pings(spark, sf_dir), "vehicle", _ORDER, cap_us=CAP).select("event_id", "vehicle", "gap_us")


@query(f"WITH {PINGS_SQL} SELECT event_id, vehicle, sum(k) {_ROWS} AS total FROM pings", whole=("total",))
def w02_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_total(pings(spark, sf_dir), "vehicle", _ORDER, "k").select("event_id", "vehicle", "total")


@query(f"""WITH {PINGS_SQL}, t AS (SELECT event_id, vehicle, speed, sum(speed) {_ROWS} AS total, CASE WHEN k % 10 = 0 THEN speed * 7 ELSE sum(speed) {_ROWS} END AS told FROM pings)
SELECT event_id, vehicle, told FROM t WHERE told <> total""", whole=("told",))
def w03_source_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the source's own cumulative disagrees with the derived one, the source's is kept as an exception."""
    run = S.running_total(pings(spark, sf_dir), "vehicle", _ORDER, "speed")
    told = run.withColumn("told", F.when(F.col("k") % 10 == 0, F.col("speed") * 7).otherwise(F.col("total")))
    return told.where("told <> total").select("event_id", "vehicle", "told")


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, speed > 3000 AS fast, lag(speed > 3000) {_W} AS was, us - lag(us) {_W} AS gap FROM pings),
g AS (SELECT *, sum(CASE WHEN fast AND (was IS NULL OR NOT was OR gap > {SILENCE}) THEN 1 ELSE 0 END) {_ROWS} AS grp FROM f)
SELECT vehicle, min(us) AS start_us, max(us) AS end_us, count(*) AS fixes, max(speed) AS peak, arg_max(event_id, (speed, -event_id)) AS peak_event
FROM g WHERE fast GROUP BY vehicle, grp""")
def w04_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overspeed episodes: runs above the limit, ended by a slower fix or by silence, with the peak and where it was."""
    runs = S.episodes(pings(spark, sf_dir), "vehicle", _ORDER, F.col("speed") > 3000, SILENCE)
    return runs.groupBy("vehicle", "grp").agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.count(F.lit(1)).alias("fixes"),
        F.max("speed").alias("peak"),
        F.max_by("event_id", F.struct("speed", -F.col("event_id"))).alias("peak_event"),
    ).drop("grp")


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, CASE WHEN moving IS DISTINCT FROM lag(moving) {_W} THEN 1 ELSE 0 END AS new FROM pings),
g AS (SELECT *, sum(new) {_ROWS} AS grp FROM f)
SELECT vehicle, grp AS run, any_value(moving) AS moving, min(us) AS start_us, max(us) AS end_us, count(*) AS fixes FROM g GROUP BY vehicle, grp""", whole=("run",))
def w05_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length encoding of the moving flag."""
    df = S.islands(pings(spark, sf_dir), "vehicle", _ORDER, S.changed("moving", "vehicle", _ORDER), "run")
    return df.groupBy("vehicle", "run").agg(F.first("moving").alias("moving"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("fixes"))


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, CASE WHEN moving IS DISTINCT FROM lag(moving) {_W} OR us - lag(us) {_W} > {SILENCE} THEN 1 ELSE 0 END AS new FROM pings),
g AS (SELECT *, sum(new) {_ROWS} AS grp FROM f),
n AS (SELECT vehicle, grp, event_type, count(*) AS c FROM g WHERE NOT moving GROUP BY ALL),
b AS (SELECT vehicle, grp, min(us) AS start_us, max(us) AS end_us, count(*) AS fixes, median(k) AS mid_k FROM g WHERE NOT moving GROUP BY vehicle, grp)
SELECT b.vehicle, start_us, end_us, fixes, mid_k, CASE WHEN fixes < 2 THEN 'few' WHEN end_us - start_us < {HOUR} THEN 'short' ELSE 'stop' END AS verdict,
  (SELECT arg_max(event_type, (c, event_type)) FROM n WHERE n.vehicle = b.vehicle AND n.grp = b.grp) AS dominant FROM b""")
def w07_stop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of standing fixes, split by silence as well, with the reason why a block is no stop, and its dominant name."""
    df = pings(spark, sf_dir)
    gap = F.col("us") - F.lag("us").over(S.series("vehicle", *_ORDER))
    df = S.islands(df, "vehicle", _ORDER, S.changed("moving", "vehicle", _ORDER) | F.coalesce(gap > SILENCE, F.lit(False))).where("not moving")
    names = df.groupBy("vehicle", "grp", "event_type").agg(F.count(F.lit(1)).alias("c"))
    top = names.groupBy("vehicle", "grp").agg(F.max_by("event_type", F.struct("c", "event_type")).alias("dominant"))
    blocks = df.groupBy("vehicle", "grp").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("fixes"), F.median("k").alias("mid_k"))
    verdict = F.when(F.col("fixes") < 2, "few").when(F.col("end_us") - F.col("start_us") < HOUR, "short").otherwise("stop")
    return blocks.join(top, ["vehicle", "grp"]).withColumn("verdict", verdict).drop("grp")


@query(f"""WITH {PINGS_SQL}, f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {_W} THEN 1 ELSE 0 END AS new, lead(us) {_W} AS next FROM pings),
g AS (SELECT *, sum(new) {_ROWS} AS grp FROM f),
v AS (SELECT vehicle, grp, any_value(event_type) AS name, sum(coalesce(next - us, 0)) AS dwell FROM g GROUP BY vehicle, grp)
SELECT vehicle, name, count(*) AS visits, sum(dwell) AS dwell_us, max(dwell) AS longest_us FROM v GROUP BY vehicle, name""", whole=("dwell_us", "longest_us",))
def w08_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive fixes at one waypoint become a visit; visits and dwell per waypoint."""
    df = pings(spark, sf_dir).withColumn("next", F.lead("us").over(S.series("vehicle", *_ORDER)))
    df = S.islands(df, "vehicle", _ORDER, S.changed("event_type", "vehicle", _ORDER))
    visits = df.groupBy("vehicle", "grp").agg(F.first("event_type").alias("name"), F.sum(F.coalesce(F.col("next") - F.col("us"), F.lit(0))).alias("dwell"))
    return visits.groupBy("vehicle", "name").agg(F.count(F.lit(1)).alias("visits"), F.sum("dwell").alias("dwell_us"), F.max("dwell").alias("longest_us"))


@query(f"""WITH {PINGS_SQL}, s AS (SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 7 END AS state FROM pings),
p AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT event_id, vehicle, before AS from_state, state AS to_state FROM p WHERE state IS NOT NULL AND before IS NOT NULL AND state <> before""")
def w09_border_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the last known state; unknown states neither start nor end anything."""
    df = pings(spark, sf_dir).withColumn("state", F.when(F.col("k") % 3 != 0, F.col("k") % 7))
    before = F.last("state", ignorenulls=True).over(S.series("vehicle", *_ORDER).rowsBetween(Window.unboundedPreceding, -1))
    crossed = df.withColumn("before", before).where("state is not null and before is not null and state <> before")
    return crossed.select("event_id", "vehicle", F.col("before").alias("from_state"), F.col("state").alias("to_state"))


@query(f"""WITH {PINGS_SQL}, d AS (SELECT event_id, vehicle, speed - lag(speed) {_W} AS delta, us - lag(us) {_W} AS gap FROM pings)
SELECT event_id, vehicle, delta, CASE WHEN delta > 0 THEN 'accelerate' ELSE 'brake' END AS kind FROM d WHERE abs(delta) >= 2000 AND gap <= {CAP}""")
def w11_harsh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.series("vehicle", *_ORDER)
    df = pings(spark, sf_dir).select("event_id", "vehicle", (F.col("speed") - F.lag("speed").over(w)).alias("delta"), (F.col("us") - F.lag("us").over(w)).alias("gap"))
    return df.where((F.abs("delta") >= 2000) & (F.col("gap") <= CAP)).select("event_id", "vehicle", "delta", F.when(F.col("delta") > 0, "accelerate").otherwise("brake").alias("kind"))


@query(f"""WITH {PINGS_SQL}, m AS (SELECT *, us - lag(us) {_W} AS gap FROM pings WHERE moving),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {SILENCE} THEN 1 ELSE 0 END) {_ROWS} AS grp FROM m),
r AS (SELECT vehicle, max(us) - min(us) AS span FROM g GROUP BY vehicle, grp) SELECT vehicle, max(span) AS longest_us, count(*) AS drives FROM r GROUP BY vehicle""")
def w12_longest_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest drive, short pauses allowed."""
    df = pings(spark, sf_dir).where("moving")
    gap = F.col("us") - F.lag("us").over(S.series("vehicle", *_ORDER))
    drives = S.islands(df, "vehicle", _ORDER, gap > SILENCE).groupBy("vehicle", "grp").agg((F.max("us") - F.min("us")).alias("span"))
    return drives.groupBy("vehicle").agg(F.max("span").alias("longest_us"), F.count(F.lit(1)).alias("drives"))


@query(f"""WITH {PINGS_SQL} SELECT vehicle, 100.0 * count(*) FILTER (WHERE (us // {HOUR}) % 24 < 6) / count(*) AS night_share,
  greatest(0, least(100, 100 - 5 * count(*) FILTER (WHERE speed > 5000) - 2 * count(*) FILTER (WHERE NOT moving AND speed > 3000))) AS score FROM pings GROUP BY vehicle""")
def w13_night_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    night = F.count_if(F.floor(F.col("us") / HOUR) % 24 < 6)
    score = 100 - 5 * F.count_if(F.col("speed") > 5000) - 2 * F.count_if(~F.col("moving") & (F.col("speed") > 3000))
    return pings(spark, sf_dir).groupBy("vehicle").agg((100.0 * night / F.count(F.lit(1))).alias("night_share"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))


@query(f"""WITH {PINGS_SQL} SELECT vehicle, us // (6 * {HOUR}) AS slot, max(k) - min(k) AS progress, max(speed) AS fastest, sum(speed) AS speed_sum, count(*) AS fixes FROM pings GROUP BY ALL""", whole=("speed_sum",))
def w14_tumbling_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.col("us") / (6 * HOUR))
    return pings(spark, sf_dir).groupBy("vehicle", slot.alias("slot")).agg((F.max("k") - F.min("k")).alias("progress"), F.max("speed").alias("fastest"), F.sum("speed").alias("speed_sum"), F.count(F.lit(1)).alias("fixes"))


@query(f"""WITH {PINGS_SQL}, n AS (SELECT event_id, vehicle, row_number() {_W} AS rn, count(*) OVER (PARTITION BY vehicle) AS c FROM pings)
SELECT event_id, vehicle FROM n WHERE (rn - 1) % 5 = 0 OR rn = c""")
def w15_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth fix and the last: an operator that thins a trail for display."""
    df = pings(spark, sf_dir).withColumns({"rn": F.row_number().over(S.series("vehicle", *_ORDER)), "c": F.count(F.lit(1)).over(Window.partitionBy("vehicle"))})
    return df.where("(rn - 1) % 5 = 0 or rn = c").select("event_id", "vehicle")


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, max(us) OVER (PARTITION BY vehicle) AS newest, row_number() OVER (PARTITION BY vehicle ORDER BY us DESC, event_id DESC) AS rn FROM pings)
SELECT vehicle, count(*) FILTER (WHERE us > newest - 7 * 24 * {HOUR}) AS last_7d, count(*) FILTER (WHERE us > newest - 24 * {HOUR}) AS last_24h, sum(speed) FILTER (WHERE rn <= 20) AS last_20_speed FROM n GROUP BY vehicle""", whole=("last_20_speed",))
def w17_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that reach back from each vehicle's own newest fix."""
    df = pings(spark, sf_dir).withColumns({"newest": F.max("us").over(Window.partitionBy("vehicle")), "rn": F.row_number().over(Window.partitionBy("vehicle").orderBy(F.desc("us"), F.desc("event_id")))})
    since = lambda hours: F.count_if(F.col("us") > F.col("newest") - hours * HOUR)
    return df.groupBy("vehicle").agg(since(168).alias("last_7d"), since(24).alias("last_24h"), F.sum(F.when(F.col("rn") <= 20, F.col("speed"))).alias("last_20_speed"))


@query(f"""WITH {PINGS_SQL}, s AS (SELECT event_id, vehicle, speed, count(*) OVER w AS n, sum(speed) OVER w AS t, sum(speed * speed) OVER w AS q FROM pings WINDOW w AS (PARTITION BY vehicle))
SELECT event_id, vehicle, speed FROM s WHERE n >= 10 AND (n * speed - t) * (n * speed - t) * (n - 1) > 4 * n * (n * q - t * t)""")
def w18_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes more than two standard deviations from their vehicle's mean, in whole-number arithmetic: (x - m)^2 > 4 s^2."""
    w = Window.partitionBy("vehicle")
    df = pings(spark, sf_dir).withColumns({"n": F.count(F.lit(1)).over(w), "t": F.sum("speed").over(w), "q": F.sum(F.col("speed") * F.col("speed")).over(w)})
    return df.where("n >= 10 and (n * speed - t) * (n * speed - t) * (n - 1) > 4 * n * (n * q - t * t)").select("event_id", "vehicle", "speed")


@query(f"""WITH {PINGS_SQL}, d AS (SELECT us // (24 * {HOUR}) AS day, count(*) AS fixes FROM pings GROUP BY ALL)
SELECT day, fixes, sum(fixes) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sum_7, sum(fixes) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS sum_14,
  rank() OVER (ORDER BY fixes DESC) AS rnk FROM d""", whole=("sum_14", "sum_7",))
def w20_rolling_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling windows over daily totals; the unpartitioned window only sees days."""
    days = pings(spark, sf_dir).groupBy(F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.count(F.lit(1)).alias("fixes"))
    by_day = Window.orderBy("day")
    return days.withColumns({"sum_7": F.sum("fixes").over(by_day.rowsBetween(-6, 0)), "sum_14": F.sum("fixes").over(by_day.rowsBetween(-13, 0)), "rnk": F.rank().over(Window.orderBy(F.desc("fixes"))).cast("long")})


@query(f"""WITH RECURSIVE {PINGS_SQL}, d AS (SELECT vehicle % 10 AS lane, us // (24 * {HOUR}) AS day, count(*)::DOUBLE AS v FROM pings GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY day) AS rn, count(*) OVER (PARTITION BY lane) AS c FROM d),
f AS (SELECT lane, rn, c, v AS smoothed FROM n WHERE rn = 1 UNION ALL SELECT n.lane, n.rn, n.c, 0.3::DOUBLE * n.v + 0.7::DOUBLE * f.smoothed FROM f JOIN n ON n.lane = f.lane AND n.rn = f.rn + 1)
SELECT lane, smoothed FROM f WHERE rn = c""")
def w21_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing of daily demand per lane."""
    days = pings(spark, sf_dir).groupBy((F.col("vehicle") % 10).alias("lane"), F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.count(F.lit(1)).alias("v"))
    return S.smoothed(days, "lane", ["day"], "v", 0.3)


@query(f"""WITH {PINGS_SQL}, s AS (SELECT event_id, vehicle, k AS target, list(k) OVER (PARTITION BY vehicle ORDER BY us, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS past FROM pings)
SELECT event_id, vehicle, target, array_to_string(past, ',') AS past FROM s WHERE len(past) = 10""")
def w22_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten past values and the next one, as training rows of a forecast."""
    past = F.collect_list("k").over(S.series("vehicle", *_ORDER).rowsBetween(-10, -1))
    return pings(spark, sf_dir).select("event_id", "vehicle", F.col("k").alias("target"), past.alias("past")).where(F.size("past") == 10).withColumn("past", F.array_join(F.col("past").cast("array<string>"), ","))


@query(f"""WITH {PINGS_SQL}, d AS (SELECT DISTINCT vehicle, us // (24 * {HOUR}) AS day FROM pings), g AS (SELECT *, day - row_number() OVER (PARTITION BY vehicle ORDER BY day) AS grp FROM d),
r AS (SELECT vehicle, count(*) AS days, max(day) AS until FROM g GROUP BY vehicle, grp) SELECT vehicle, arg_max(days, until) AS streak, max(days) AS longest FROM r GROUP BY vehicle""")
def w24_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive active days: the streak that ends last, and the longest."""
    days = pings(spark, sf_dir).select("vehicle", F.floor(F.col("us") / (24 * HOUR)).alias("day")).distinct()
    numbered = days.withColumn("grp", F.col("day") - F.row_number().over(S.series("vehicle", "day")))
    runs = numbered.groupBy("vehicle", "grp").agg(F.count(F.lit(1)).alias("days"), F.max("day").alias("until"))
    return runs.groupBy("vehicle").agg(F.max_by("days", "until").alias("streak"), F.max("days").alias("longest"))


@query(f"""WITH {PINGS_SQL}, u AS (SELECT vehicle, us // {HOUR} AS hour, speed, min(event_id) AS event_id FROM pings GROUP BY ALL)
SELECT vehicle, hour, speed, row_number() OVER (PARTITION BY vehicle, hour ORDER BY event_id) - 1 AS seq FROM u""")
def w26_physical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same vehicle, time and reading: the same fix. Another reading at that time gets the next sequence number."""
    one = pings(spark, sf_dir).groupBy("vehicle", F.floor(F.col("us") / HOUR).alias("hour"), "speed").agg(F.min("event_id").alias("event_id"))
    return one.withColumn("seq", F.row_number().over(S.series(["vehicle", "hour"], "event_id")).cast("long") - 1).drop("event_id")


@query(f"""WITH {PINGS_SQL} SELECT vehicle, arg_min(event_type, (us, event_id)) AS origin, arg_max(event_type, (us, event_id)) AS destination, median(k) AS mid FROM pings GROUP BY vehicle""")
def w27_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("us", "event_id")
    return pings(spark, sf_dir).groupBy("vehicle").agg(F.min_by("event_type", at).alias("origin"), F.max_by("event_type", at).alias("destination"), F.median("k").alias("mid"))


@query()
def w28_teleport_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes that could not have been reached from the last accepted one. Sequential, so tested and not in SQL."""
    df = pings(spark, sf_dir).select("event_id", "vehicle", "us", "speed", "k")
    return S.clean_trail(df, "vehicle", "us", "speed", "k", 0.2).select("event_id", "vehicle", "kept")


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, us - lag(us) OVER (PARTITION BY vehicle ORDER BY event_id) < 0 AS late FROM pings) SELECT vehicle, count(*) FILTER (WHERE late) AS late, count(*) AS fixes,
 CASE WHEN count(*) < 5 THEN 'sparse' WHEN count(*) FILTER (WHERE late) > 0 THEN 'noisy' ELSE 'good' END AS quality FROM n GROUP BY vehicle""")
def w31_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-order arrivals and a verdict on the trail."""
    df = pings(spark, sf_dir).withColumn("late", F.col("us") < F.lag("us").over(S.series("vehicle", "event_id")))
    late = F.count_if("late")
    return df.groupBy("vehicle").agg(late.alias("late"), F.count(F.lit(1)).alias("fixes"), F.when(F.count(F.lit(1)) < 5, "sparse").when(late > 0, "noisy").otherwise("good").alias("quality"))


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, lag(k) {_W} AS a, lead(k) {_W} AS b FROM pings) SELECT event_id, vehicle, k, a AS mended FROM n WHERE a = b AND abs(k - a) >= 30""")
def w34_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-and-back spikes: a fix far from two equal neighbours."""
    w = S.series("vehicle", *_ORDER)
    df = pings(spark, sf_dir).withColumns({"a": F.lag("k").over(w), "b": F.lead("k").over(w)})
    return df.where((F.col("a") == F.col("b")) & (F.abs(F.col("k") - F.col("a")) >= 30)).select("event_id", "vehicle", "k", F.col("a").alias("mended"))


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, us - lag(us) {_W} AS gap, abs(k - lag(k) {_W}) AS moved FROM pings) SELECT event_id, vehicle, gap, CASE WHEN moved >= 30 THEN 'moving' ELSE 'standing' END AS kind FROM n WHERE gap >= {SILENCE}""")
def w36_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences, and whether the asset moved meanwhile."""
    w = S.series("vehicle", *_ORDER)
    df = pings(spark, sf_dir).withColumns({"gap": F.col("us") - F.lag("us").over(w), "moved": F.abs(F.col("k") - F.lag("k").over(w))})
    return df.where(F.col("gap") >= SILENCE).select("event_id", "vehicle", "gap", F.when(F.col("moved") >= 30, "moving").otherwise("standing").alias("kind"))


@query(f"""WITH {PINGS_SQL}, n AS (SELECT *, abs(k - lag(k) {_W}) AS leg, us - lag(us) {_W} AS gap FROM pings) SELECT event_id, vehicle, sum(CASE WHEN gap <= {SILENCE} THEN leg ELSE 0 END) {_ROWS} AS odometer FROM n""", whole=("odometer",))
def w37_odometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path length that leaves silences out."""
    w = S.series("vehicle", *_ORDER)
    df = pings(spark, sf_dir).withColumns({"leg": F.abs(F.col("k") - F.lag("k").over(w)), "gap": F.col("us") - F.lag("us").over(w)})
    df = df.withColumn("leg", F.when(F.col("gap") <= SILENCE, F.col("leg")).otherwise(0))
    return S.running_total(df, "vehicle", _ORDER, "leg", "odometer").select("event_id", "vehicle", "odometer")


@query(f"""WITH {PINGS_SQL} SELECT (us // (24 * {HOUR}) + 3) % 7 AS weekday, (us // {HOUR}) % 24 AS hour, count(*) AS fixes, count(*) FILTER (WHERE moving) AS moving FROM pings GROUP BY ALL""")
def w40_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday by hour; day 0 of 1970 was a Thursday, weekday 0 is Monday."""
    weekday, hour = (F.floor(F.col("us") / (24 * HOUR)) + 3) % 7, F.floor(F.col("us") / HOUR) % 24
    return pings(spark, sf_dir).groupBy(weekday.alias("weekday"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("fixes"), F.count_if("moving").alias("moving"))
