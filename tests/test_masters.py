"""Clients' lists of circles, published lists, and crossings of circles against one machine at a time."""

import json
import math

from pyspark.sql import functions as F

from wayfold.functions.scalars import EARTH_M
from wayfold.operators import circles as C
from wayfold.operators.scenes import centroids
from wayfold.operators.trackers import CircleRuns
from wayfold.sources import masters as M
from wayfold.sources.tables import HOUR
from wayfold.sources.trails import trails, zones

SF = "/root/testdata/sf0.001"


def test_columns_by_their_headers():
    assert M.columns_of(["Location Name", "GEO_FENCE-LAT", "Lng ", "Geofence Radius (m)", "Type"]) == {"name": "Location Name", "lat": "GEO_FENCE-LAT", "lon": "Lng ", "radius": "Geofence Radius (m)", "role": "Type"}
    assert M.columns_of(["Unloading Point Latitude", "Unloading Point Longitude", "x name"]) == {"lat": "Unloading Point Latitude", "lon": "Unloading Point Longitude"}


def test_checks_preview_and_import(spark):
    rows = [("Pithampur", "22.6", "75.6", None, None), (" pithampur ", "22.7", "75.6", "100.9", "destination"), (None, "22", "75", "1", None), ("A", "x", "75", None, None), ("B", "86.2", "22.8", None, None), ("C", "22", "75", "49", None), ("D", "22", "75", "NaN", None), ("E", "22", "75", None, "gate"), ("F", "-95", "0", None, None), ("G", "50", "75", None, None), ("Mill Gate", "22", "75", None, "Origin")]
    checked = M.checked_circles(spark.createDataFrame(rows, "`Node Name` string, Lat string, Long string, Radius string, Role string"), (6.0, 68.0, 37.5, 97.5))
    assert [r.reject for r in checked.collect()] == [None, None, "no name", "no place", "latitude and longitude look swapped", "radius out of bounds", "radius is no number", "unknown role", "out of range", "outside the area", None]
    held = spark.createDataFrame([("PITHAMPUR", "destination", 22.6, 75.6, 500, "derived"), ("OTHER", "origin", 1.0, 1.0, 500, "derived")], "key string, role string, lat double, lon double, radius_m int, source string")
    used = spark.createDataFrame([("Pithampur (M.P.)",), ("mill  gate",), (None,)], "name string")
    shown = M.preview(checked, held, used)
    got = {r.key: r for r in shown.collect()}
    assert set(got) == {"PITHAMPUR", "MILL GATE"} and got["PITHAMPUR"].action == "update" and abs(got["PITHAMPUR"].shift_m - 11_120) < 20 and got["PITHAMPUR"].radius_m == 100
    assert got["PITHAMPUR"].unmatched and got["PITHAMPUR"].meant == "PITHAMPUR (M.P.)" and not got["MILL GATE"].unmatched and got["MILL GATE"].action == "insert"
    assert {(r.key, r.source) for r in M.imported(held, shown).collect()} == {("PITHAMPUR", "client"), ("MILL GATE", "client"), ("OTHER", "derived")}


def test_published_lists(spark, tmp_path):
    (tmp_path / "plazas.json").write_text(json.dumps({"published": "2026-04-01", "plazas": [{"code": "1", "name": "a"}, {"code": "2", "name": "b"}]}, indent=1))
    rows, counts = M.read_list(spark, str(tmp_path / "plazas.json"), "plazas")
    assert sorted((r.code, r.name, str(r.as_of)) for r in rows.collect()) == [("1", "a", "2026-04-01"), ("2", "b", "2026-04-01")] and counts.first().rows == 2


def test_circle_crossings_equal_one_machine_at_a_time(spark):
    around = centroids(zones(spark, SF)).select(F.col("zone").alias("circle"), "lat6", "lon6", (500.0 + (F.col("zone") % 7) * 2_300).alias("radius"))
    series = {}
    for r in sorted(trails(spark, SF).collect(), key=lambda r: (r.us, r.event_id)):
        series.setdefault(r.vehicle, []).append(r)

    def metres(a, b):
        p, q = math.radians(a.lat6 * 1e-6), math.radians(b.lat6 * 1e-6)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians((b.lon6 - a.lon6) * 1e-6) / 2) ** 2
        return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, h)))

    want, pairs = [], set()
    for c in around.collect():
        for v, own in series.items():
            radii = [metres(f, c) / c.radius for f in own]
            if min(radii) <= 1:
                pairs.add((v, c.circle))
                machine = CircleRuns(1.0, 8 * HOUR, 2.0)
                want += [(v, c.circle, *x) for f, d in zip(own, radii) for x in machine.step(f.us, d)]
    assert {(r.vehicle, r.circle) for r in C.touched(trails(spark, SF), around).collect()} == pairs and len(pairs) > 30
    assert sorted(map(tuple, C.crossings(trails(spark, SF), around, 8 * HOUR, 2.0).collect())) == sorted(want) and len(want) > 30
