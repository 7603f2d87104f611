"""Feeds and sinks."""

import json
import zlib

from pyspark.sql import functions as F

from wayfold.functions import scalars as X
from wayfold.sources import feeds, sinks


def test_payloads(spark):
    good = zlib.compress(json.dumps({"vehicle": "V1", "trip": {"no": "7"}, "gps": [{"ts": "2024-01-01 10:00:00", "lat": 1.5, "lon": 2.5, "speed": 30.0}]}).encode())
    bare = zlib.compress(json.dumps({"vehicle": "V2", "trip": {}}).encode())
    df = spark.createDataFrame([(1, good), (2, bare), (3, b"broken"), (4, None)], "part int, payload binary")
    rows = {r.part: r for r in feeds.decoded_payloads(df).collect()}
    assert rows[1].vehicle == "V1" and rows[1].trip["no"] == "7" and rows[1].lat == 1.5 and rows[1].ts.hour == 10
    assert rows[2].vehicle == "V2" and rows[2].ts is None and rows[3].vehicle is None and rows[4].vehicle is None


def test_exports(spark, tmp_path):
    (tmp_path / "a.txt").write_text('head { not json\n{"a": 1}\ntext [ {"b": 2}, {"c": {"d": 3}} ] tail')
    rows = feeds.read_exports(spark, str(tmp_path)).orderBy("section").collect()
    assert [json.loads(r.body) for r in rows] == [{"a": 1}, {"b": 2}, {"c": {"d": 3}}]


def test_csv_with_any_header(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Vehicle No,Time,Latitude,LNG,kmph\nV1,01/02/2024 10:00:00,20.5,75.1,\"1,234\"\n n/a ,bad,1,1,\nV3,2024-02-01 10:00:00,0,0,5\nV4,2024-02-01 10:00:00,95,10,5\n")
    rows = {r.vehicle: r for r in feeds.read_csv_fixes(spark, str(tmp_path)).collect()}
    assert rows["V1"].reject is None and rows["V1"].speed == 1234.0 and (rows["V1"].ts.day, rows["V1"].ts.month) == (1, 2)
    assert rows[None].reject == "no_time" and rows["V3"].reject == "zero_island" and rows["V4"].reject == "out_of_range"


def test_rings_and_regions(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, 1.0, 0.0), ("a", 1, 0.0, 0.0), ("a", 2, 0.0, 1.0), ("b", 1, 0.0, 0.0)], "site string, seq int, lat double, lon double")
    rows = {r.site: r for r in feeds.rings(df).collect()}
    assert [(p.lat, p.lon) for p in rows["a"].ring] == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)] and rows["b"].reject == "too_few_corners"
    layer = {"type": "FeatureCollection", "features": [{"properties": {"st": "X"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}}]}
    (tmp_path / "r.json").write_text(json.dumps(layer))
    regions = feeds.read_regions(spark, str(tmp_path / "r.json"), "st")
    hit = regions.select("name", X.point_in_ring(F.lit(1.0), F.lit(1.0), F.col("ring")).alias("inside"), X.point_in_ring(F.lit(3.0), F.lit(1.0), F.col("ring")).alias("outside")).first()
    assert (hit.name, hit.inside, hit.outside) == ("X", True, False)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, day string")
    sinks.append(df, path, "day")
    sinks.replace_partitions(df.where("day = '2024-01-02'").withColumn("v", F.lit(9)), path, "day")
    assert sorted((r.v, str(r.day)) for r in spark.read.parquet(path).collect()) == [(1, "2024-01-01"), (9, "2024-01-02")]
    kept = sinks.archive(df, str(tmp_path / "old"), "2024-01-02")
    assert [r.v for r in kept.collect()] == [2] and spark.read.json(str(tmp_path / "old")).count() == 1
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
