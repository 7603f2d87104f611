"""What the findings on larger tables were about, seen in plans, partitions and small tables of large numbers."""

from wayfold.operators import zones as Z
from wayfold.plans.zone_queries import ESCAPE
from wayfold.sources.trails import trails, zones

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_many_zones_are_not_broadcast(spark, monkeypatch):
    fixes, master = trails(spark, SF), zones(spark, SF)
    assert "BroadcastHashJoin" in plan(Z.fixes_near(fixes, master, ESCAPE))
    monkeypatch.setattr(Z, "FEW", 10)
    assert "BroadcastHashJoin" not in plan(Z.fixes_near(fixes, master, ESCAPE))


def test_areas_of_zones_are_not_broadcast(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(Z, "FEW", 10)
    for name in ("t07_innermost_zone", "g12_regions", "m07_visits", "m07_violations"):
        assert "zone" not in "".join(x for x in plan(entry.queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in x), name


def test_outlines_of_a_small_file_are_spread(spark):
    from pyspark.sql import functions as F

    assert zones(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_rings_side_by_side_equal_each_alone():
    import numpy as np

    from wayfold.operators.rings import inscribed_radii, inscribed_radius

    rng = np.random.default_rng(3)
    rings = [(rng.integers(0, 30_000, n), rng.integers(0, 30_000, n)) for n in (0, 2, 3, 5, 5, 5, 12, 12, 40)] + [(np.zeros(4, int), np.arange(4))]
    for cap in (200.0, 5_000.0):
        assert inscribed_radii([a for a, _ in rings], [b for _, b in rings], cap) == [inscribed_radius(*r, cap) for r in rings]


def test_nested_boxes_are_not_broadcast(spark):
    from wayfold.plans.filter_queries import j18_nesting

    assert "BroadcastHashJoin" not in plan(j18_nesting(spark, SF))


def test_correlation_of_sums_beyond_64_bits(spark, tmp_path):
    import datetime
    import math

    from wayfold.plans.scorecard_queries import a34_correlation

    first, n = datetime.datetime(1, 1, 1), 1_200
    lines = [(i, 1, i, 1, 1.0, "N", first) for i in range(n)] + [(i, 1, i, k, 1.0, "N", first + datetime.timedelta(days=3_600_000 + 37 * i)) for i in range(n) for k in range(2, 3 + i % 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber long, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(i, 1, "F", "1", first, 1.0) for i in range(n)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    x, y = [3_600_000 + 37 * i for i in range(n)], [2 + i % 3 for i in range(n)]
    apart = lambda a, b: n * sum(p * q for p, q in zip(a, b)) - sum(a) * sum(b)
    assert n * sum(v * v for v in x) > 2**63
    want = math.floor(1e6 * apart(x, y) / math.sqrt(float(apart(x, x)) * float(apart(y, y))) + 0.5)
    assert [tuple(r) for r in a34_correlation(spark, str(tmp_path)).collect()] == [("F", n, want)]


def test_occupancy_is_dealt_by_the_number_of_its_rows(spark, monkeypatch):
    from wayfold.operators import intervals as I
    from wayfold.sources.tables import stays

    df = stays(spark, SF)
    want = sorted(map(tuple, I.occupancy(df, ["site"]).collect()), key=str)
    monkeypatch.setattr(I, "PART", 100, raising=False)
    spread = I.occupancy(df, ["site"])
    assert f"{-(-df.count() // 100)}), REPARTITION_BY_NUM" in plan(spread)
    assert sorted(map(tuple, spread.collect()), key=str) == want


def test_time_at_sites_is_dealt_by_the_number_of_its_rows(spark, monkeypatch):
    from wayfold.operators import intervals as I
    from wayfold.plans.interval_queries import i06_time_at_sites

    monkeypatch.setattr(I, "PART", 100, raising=False)
    assert "REPARTITION_BY_NUM" in plan(i06_time_at_sites(spark, SF))


def test_clipped_union_and_refreshed_view_are_dealt_by_the_number_of_their_rows(spark, monkeypatch):
    from wayfold.operators import intervals as I
    from wayfold.plans.detail_queries import c41_clipped_union
    from wayfold.plans.register_queries import t11_refreshed_view

    monkeypatch.setattr(I, "PART", 100)
    for query in (c41_clipped_union, t11_refreshed_view):
        assert "REPARTITION_BY_NUM" in plan(query(spark, SF))


def test_crowded_runs_are_found_in_buckets_and_joined(spark):
    import re

    from pyspark.sql import functions as F

    from wayfold.operators import intervals as I
    from wayfold.sources.tables import stays

    df = stays(spark, SF).withColumn("site", F.col("site") % 3)
    whole, cut = (I.runs_at_least(I.occupancy(df, ["site"], bucket_us=n * I.DAY), ["site"], F.lit(3)) for n in (100_000, 1))
    assert not re.search(r"windowspecdefinition\(site#\d+L?, us#", plan(cut))
    want = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, cut.collect())) == want and any(enter // I.DAY != (leave - 1) // I.DAY for _, enter, leave, _ in want)


def test_circles_meet_fixes_once(spark):
    from wayfold.plans.master_queries import c27_circle_crossings

    joins = [x for x in plan(c27_circle_crossings(spark, SF)).splitlines() if "Join" in x]
    assert len(joins) == 1


def test_lines_of_an_upload_are_not_held():
    import tracemalloc

    from wayfold.sources.uploads import lines_of

    for data in (b"ts,lat,lon\n" + b"2026-04-05 06:07:08,22.5,80.5\n" * 60_000, b'{"ts": 1752732714, "lat": 1, "lon": 2}\n' * 60_000):
        tracemalloc.start()
        assert sum(1 for _ in lines_of("a", data)) == 60_000
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4 * len(data)


def test_a_file_that_breaks_late_gives_no_lines():
    from wayfold.sources.uploads import lines_of

    found = list(lines_of("a", b'{"ts": 1752732714, "lat": 1, "lon": 2}\n' * 100 + b"{"))
    assert len(found) == 1 and found[0][6].startswith("unreadable")


def test_models_learn_from_trips_that_are_joined_once(spark, monkeypatch):
    from wayfold.plans import model_queries as M

    plans = []
    monkeypatch.setattr(M.G, "trained", lambda rows, *a, **k: plans.append(plan(rows)))
    for query in (M.n01_travel_time_model, M.n10_fuel_model):
        query(spark, SF)
    assert len(plans) == 2 and not any("SortMergeJoin" in p or "lineitem" in p for p in plans)


def test_order_of_arrival_needs_no_state_store_of_its_own(spark, tmp_path):
    from wayfold.streaming import live

    rows = [[(1, 1, 10, 1), (1, 2, 8, 2), (2, 3, 5, 3)], [(1, 4, 10, 4), (1, 5, 12, 6), (1, 6, 11, 5), (2, 7, 4, 7)]]
    for k, own in enumerate(rows):
        spark.createDataFrame(own, "vehicle long, event_id long, us long, arrival long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("vehicle long, event_id long, us long, arrival long").parquet(str(tmp_path / "in"))
        live.in_order(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    out = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [1, 3, 5, 6]


def test_places_of_other_plants_are_not_paired(spark, monkeypatch):
    from wayfold.operators import scenes as C

    plants = [None, 0, 1, 2, 3, 4]
    places = spark.createDataFrame([(z, [0, 0, 1_000, 1_000], [0, 1_000, 1_000, 0], 2_000_000) for z in range(12)], "zone long, lats array<long>, lons array<long>, area2 long")
    episodes = spark.createDataFrame([(z, plants[z // 2], z, 0, 10) for z in range(12)], "episode long, plant long, zone long, start_us long, end_us long")
    crowd = spark.createDataFrame([(z, 7) for z in range(12)], "episode long, vehicle long")
    met, given, join, same = [], [], C.overlap_join, C.same_places
    monkeypatch.setattr(C, "overlap_join", lambda left, *a: met.append(left.count()) or join(left, *a))
    monkeypatch.setattr(C, "same_places", lambda places, *a: given.append(plan(places)) or same(places, *a))
    got = sorted(tuple(r) for r in C.scenes(episodes, crowd, places, 4.0, 0.5, 64).collect())
    assert got == [(z, z - z % 2, z % 2 == 0) for z in range(12)]
    assert met == [6] and "REPARTITION_BY_NUM" in given[0]


def test_outlines_of_some_zones_alone_are_the_same(spark):
    from pyspark.sql import functions as F

    some = spark.createDataFrame([(3,), (17,), (-1,)], "zone long")
    want = zones(spark, SF).where(F.col("zone").isin(3, 17)).collect()
    assert sorted(zones(spark, SF, some).collect()) == sorted(want) and len(want) == 2


def test_steps_of_occupancy_are_shuffled_once(spark):
    from wayfold.plans.figure_queries import a22_usual_level
    from wayfold.plans.interval_queries import i16_baseline

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (a22_usual_level, i16_baseline):
            text = plan(query(spark, SF))
            assert text.count("REPARTITION_BY_NUM") - text.count("ReusedExchange") <= 1 and "ReusedExchange" in text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_cells_are_not_broadcast_to_summaries_and_passages(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(Z, "FEW", 10)
    for name in ("m07_trail_summary", "m16_passages"):
        joins = [x for x in plan(entry.queries()[name](spark, SF)).splitlines() if "Join" in x and "cy#" in x]
        assert joins and not any("Broadcast" in x for x in joins), name


def test_micro_batches_do_not_broadcast_the_cells_of_many_zones(spark, monkeypatch, tmp_path):
    from wayfold.streaming.runs import in_slices

    fixes = trails(spark, SF)
    in_slices(fixes, "us", 1, f"{tmp_path}/fixes")
    monkeypatch.setattr(Z, "FEW", 10)
    near = Z.fixes_near(spark.readStream.schema(fixes.schema).parquet(f"{tmp_path}/fixes"), zones(spark, SF), ESCAPE)
    run = near.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    found = run._jsq.explainInternal(False)
    assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found


def test_slices_of_trails_do_not_sort_them_again(spark, monkeypatch):
    from wayfold.plans import zone_queries as Q

    seen = []
    monkeypatch.setattr(Q, "in_slices", lambda df, *_: seen.append(plan(df)))
    monkeypatch.setattr(Q, "to_the_end", lambda *_: spark.createDataFrame([], "vehicle long, zone long, kind string, us long"))
    Q.t03_live_events(spark, SF)
    assert len(seen) == 1 and "Window" not in seen[0]
