"""Golden cases and properties of the telemetry operators."""

import random

from pyspark.sql import functions as F

from wayfold.functions import rates as R
from wayfold.functions import scalars as X
from wayfold.operators import intervals as I
from wayfold.operators import merges as K
from wayfold.operators import sequences as S
from wayfold.operators.joins import as_of, radius_join
from wayfold.operators.trackers import CircleRuns, FirstExit, Reach, Tracker, Visits
from wayfold.streaming import live

MIN = 60_000_000


def test_occupancy_is_half_open(spark):
    df = spark.createDataFrame([("s", 0, 30), ("s", 30, 60), ("s", 10, 10)], "site string, enter long, leave long")
    steps = {r.us: (r.level, r.until) for r in I.occupancy(df, ["site"]).collect()}
    assert steps == {0: (1, 60), 60: (0, None)} or steps == {0: (1, 30), 30: (1, 60), 60: (0, None)}
    assert max(level for level, _ in steps.values()) == 1


def test_level_time_and_runs(spark):
    df = spark.createDataFrame([("s", 0, 60), ("s", 10, 40), ("s", 20, 30)], "site string, enter long, leave long")
    steps = I.occupancy(df, ["site"])
    assert {r.level: r.at_level_us for r in I.level_time(steps, ["site"]).collect()} == {1: 30, 2: 20, 3: 10}
    assert [(r.enter, r.leave, r.peak) for r in I.runs_at_least(steps, ["site"], F.lit(2)).collect()] == [(10, 40, 3)]


def test_weighted_percentile(spark):
    df = spark.createDataFrame([("s", 1, 3000), ("s", 2, 300), ("s", 9, 300)], "site string, level int, w long")
    at = lambda q: I.weighted_percentile(df, ["site"], "level", "w", q).first().level
    assert (at(0.9), at(0.95)) == (2, 9)


def test_merge_touching_and_tolerance(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 25, 30)], "k string, enter long, leave long")
    assert sorted((r.enter, r.leave, r.n) for r in I.merged(df, ["k"]).collect()) == [(0, 20, 2), (25, 30, 1)]
    assert [(r.enter, r.leave) for r in I.merged(df, ["k"], tolerance_us=5).collect()] == [(0, 30)]


def test_overlap_join_equals_nested_loops(spark):
    rng = random.Random(3)
    make = lambda n, t: [(rng.randint(0, 2), i, s := rng.randint(0, 500), s + rng.randint(0, 90)) for i in range(n)]
    a, b = make(60, "a"), make(60, "b")
    left = spark.createDataFrame(a, "k int, i int, s1 long, e1 long")
    right = spark.createDataFrame(b, "k int, j int, s2 long, e2 long")
    got = {(r.i, r.j) for r in I.overlap_join(left, right, "k", 37, "s1", "e1", "s2", "e2").collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}


def test_day_split_keeps_total(spark):
    df = spark.createDataFrame([(0, I.DAY * 2 + 5), (I.DAY - 7, I.DAY + 7)], "enter long, leave long")
    assert sum(r.in_day_us for r in I.split_by_day(df).collect()) == I.DAY * 2 + 5 + 14


def test_painting(spark):
    df = spark.createDataFrame([("v", 0, 100, 1, "road"), ("v", 20, 40, 2, "stop"), ("v", 30, 60, 3, "zone")], "v string, enter long, leave long, priority int, kind string")
    assert sorted((r.enter, r.leave, r.kind) for r in I.painted(df, "v").collect()) == [(0, 20, "road"), (20, 30, "stop"), (30, 60, "zone"), (60, 100, "road")]


def test_scalar_cases(spark):
    df = spark.createDataFrame([("CRM BARA ( C036 ) ", "Moving 51 km/h", "1,234.5%"), ("PLAIN", "Stopped", "n/a"), (None, None, None)], "a string, b string, c string")
    rows = df.select(X.party_name(F.col("a")), X.party_code(F.col("a")), X.status_moving(F.col("b")), X.status_speed(F.col("b")), X.parsed_float(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("CRM BARA", "C036", 1, 51, 1234.5), ("PLAIN", None, 0, None, None), (None, None, None, None, None)]


def test_whole_word_rules(spark):
    rules = [("gate", ["GATE"]), ("loading", ["LOADING"])]
    df = spark.createDataFrame([("HSM GATE_LOCAL",), ("NAVIGATE",), ("X LOADING GATE",)], "n string")
    assert [r[0] for r in df.select(X.first_word_rule(F.col("n"), rules, "area")).collect()] == ["gate", "area", "gate"]


def test_wilson_bounds(spark):
    row = spark.range(1).select(R.wilson(F.lit(8.0), F.lit(10), False).alias("lo"), R.wilson(F.lit(8.0), F.lit(10), True).alias("hi"), R.wilson(F.lit(0.0), F.lit(0), True).alias("none")).first()
    assert abs(row.lo - 0.4901625) < 1e-6 and abs(row.hi - 0.9433178) < 1e-6 and row.none is None


S1 = 1_000_000


def run_tracker(steps, *args):
    t = Tracker(*(args or (10, 90 * S1, 250, 1_800 * S1)))
    return [x for us, d in steps for x in t.step(us * S1, d)]


def test_tracker_confirms_and_stamps():
    assert run_tracker([(0, 100), (60, -20), (120, -30), (180, -30), (240, 3), (300, 50), (330, 40), (420, 60)]) == [("enter", 60 * S1), ("exit", 240 * S1)]


def test_unclear_fixes_prolong_a_run_and_clear_ones_end_it():
    assert run_tracker([(0, -50), (60, 20), (120, 5), (180, 20)]) == [("exit", 0)]
    assert run_tracker([(0, -50), (60, 20), (120, -10), (180, 20), (210, 20)]) == []


def test_the_first_clear_fix_is_no_crossing():
    assert run_tracker([(0, -300), (100, -300)]) == []
    assert run_tracker([(0, 3), (60, -50), (400, 11), (800, 300)]) == [("exit", 60 * S1)]


def test_escape_is_beyond_the_band_on_its_side_and_inclusive():
    assert run_tracker([(0, -300), (1, 259)]) == []
    assert run_tracker([(0, -300), (1, 260)]) == [("exit", 0)]
    assert run_tracker([(0, 300), (1, -260)]) == [("enter", S1)]


def test_silence_does_not_count_as_time_held():
    assert run_tracker([(0, -50), (60, 20), (4_000, 20), (4_050, 20)]) == []
    assert run_tracker([(0, -50), (60, 20), (4_000, 20), (4_050, 20), (4_090, 20)]) == [("exit", 0)]


def test_tracker_state_survives_a_restart():
    rng = random.Random(9)
    steps = [(i * 40, rng.choice([-300, -30, -11, -5, 0, 5, 11, 30, 300])) for i in range(400)]
    args, found, state = (10, 90 * S1, 250, 1_800 * S1), [], Tracker(10, 90 * S1, 250, 1_800 * S1).state()
    for us, d in steps:
        t = Tracker(*args).restore(state)
        found += t.step(us * S1, d)
        state = t.state()
    assert found == run_tracker(steps) and len(found) > 10


def walk_all(machine, steps):
    return [x for step in steps for x in machine.step(*step)] + machine.end()


def test_visits_that_begin_before_or_end_after_the_series():
    make = lambda: Visits(Tracker(10, 90, 250, 1_800))
    assert walk_all(make(), [(0, -50), (50, 300), (100, -300), (150, -20)]) == [(0, 0, False, False), (100, 150, True, True)]
    assert walk_all(make(), [(0, -3), (50, 2)]) == [(0, 50, False, True)] and walk_all(make(), [(0, 3), (50, -2)]) == []


def test_circle_runs_absorb_jitter():
    make = lambda: CircleRuns(100, 60, 2)
    assert walk_all(make(), [(0, 50), (10, 150), (20, 50), (30, 150), (95, 150), (99, 10), (200, 10)]) == [("exit", 20), ("enter", 99)]
    assert walk_all(make(), [(0, 50), (10, 201), (20, 50)]) == [("exit", 0)]
    assert walk_all(FirstExit(make()), [(0, 150), (10, 120)]) == [("never_inside", None)]
    assert walk_all(FirstExit(make()), [(0, 50), (10, 150)]) == [("never_exited", None)]
    assert walk_all(FirstExit(make()), [(0, 50), (10, 250)]) == [("ok", 0)]


def test_a_jump_counts_if_the_next_row_follows_it():
    rows = [(0, 0.0, 0.0, 1), (S1, 50.0, 0.0, 2), (2 * S1, 2.0, 0.0, 3), (3 * S1, 90.0, 0.0, 4), (4 * S1, 91.0, 0.0, 5)]
    assert walk_all(Reach(2.0), rows) == [(1, True), (2, False), (3, True), (4, True), (5, True)]


def test_watermark_and_window():
    assert live.next_watermark(None, 50, 5) == 50 and live.next_watermark(40, 50, 5) == 50 and live.next_watermark(90, 50, 5) == 85
    assert live.window_start(100, 30, 0, 120, 1_000) == 70 and live.window_start(100, 30, 80, 120, 1_000) == 80 and live.window_start(100, 30, 0, 120, 40) == 80


def test_stream_of_crossings_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, v, (i * 600 + rng.randint(0, 300)) * 1_000_000, float(rng.randint(-60, 60))) for v in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, vehicle long, us long, distance double")
    for part in range(3):  # files in order of time, one micro-batch each
        lo, hi = part * 40, part * 40 + 40
        df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    args = (5.0, 1200 * 1_000_000, 45.0, 48 * 3600 * 1_000_000)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = live.tracked(stream, *args).writeStream.format("memory").queryName("crossed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.vehicle, r.us, r.kind)
    batch = S.crossings(df, "vehicle", "us", "distance", *args).collect()
    assert batch and sorted(map(key, spark.table("crossed").collect())) == sorted(map(key, batch))


def test_stream_dedup_and_latest(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 10, 5), (2, 1, 10, 5), (3, 1, 20, 6), (4, 2, 5, 1)], "event_id long, vehicle long, us long, speed long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = live.deduplicated(stream, "1 hour").writeStream.format("memory").queryName("once").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 3
    query = live.latest_positions(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.vehicle, r.us) for r in live.positions(spark, str(tmp_path / "out")).collect()) == [(1, 20), (2, 5)]
    # A later micro-batch with a late fix of one vehicle and a new one of another; the first one's folder is not touched.
    spark.createDataFrame([(5, 1, 15, 9), (6, 2, 30, 2)], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = live.latest_positions(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.vehicle, r.us) for r in live.positions(spark, str(tmp_path / "out")).collect()) == [(1, 20), (2, 30)]
    assert spark.read.parquet(str(tmp_path / "out" / "batch=1")).count() == 2


def test_incremental_equals_full(spark):
    rows = [(i, i % 5, i * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k int, v int")
    agg = lambda x: x.groupBy("k").agg(F.sum("v").alias("v"))
    touched = df.where("id >= 50").select("k").distinct()
    got = K.replace_keys(agg(df.where("id < 50")), agg(df.join(touched, "k", "left_semi")), touched, ["k"])
    assert sorted(got.collect()) == sorted(agg(df).collect())


def test_as_of_takes_newest_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, us long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 3, "c")], "k int, r_us long, v string")
    got = {(r.k, r.us): r.as_of_v for r in as_of(left, right, "k", "us", "r_us", ["v"]).collect()}
    assert got == {(1, 5): "a", (1, 10): "b", (2, 1): None}


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(9)
    pts = [(i, 20 + rng.random(), 75 + rng.random()) for i in range(80)]
    places = [(i, 20 + rng.random(), 75 + rng.random()) for i in range(40)]
    a = spark.createDataFrame(pts, "i int, lat double, lon double")
    b = spark.createDataFrame(places, "j int, p_lat double, p_lon double")
    got = {(r.i, r.j) for r in radius_join(a, b, 12_000, 0.15).collect()}
    far = a.crossJoin(b).where(X.haversine_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= 12_000)
    assert got == {(r.i, r.j) for r in far.collect()}


def test_clean_trail_reanchors(spark):
    rows = [(0, 1, 0, 0.0, 0.0), (1, 1, 10, 100.0, 0.0), (2, 1, 20, 1.0, 0.0), (3, 1, 30, 500.0, 0.0), (4, 1, 40, 501.0, 0.0)]
    df = spark.createDataFrame([(e, v, u * 1_000_000, x, y) for e, v, u, x, y in rows], "event_id int, v int, us long, x double, y double")
    kept = {r.event_id: r.kept for r in S.clean_trail(df, "v", "us", "x", "y", 1.0).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: True, 4: True}
