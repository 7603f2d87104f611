"""Feeds: packed payloads, sectioned exports, CSV files with any header, rings and region layers."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wayfold.functions.scalars import cleaned, parsed_float, parsed_timestamp

PAYLOAD = "vehicle string, trip map<string, string>, gps array<struct<ts: string, lat: double, lon: double, speed: double>>"
#: Headers that stand for a role, in lower case.
HEADERS = {
    "vehicle": ("vehicle", "vehicle no", "vehicle_no", "asset"),
    "ts": ("ts", "time", "timestamp", "date", "datetime"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "long", "longitude"),
    "speed": ("speed", "kmph", "speed km/h"),
}


@F.pandas_udf(StringType())
def inflated(blob: pd.Series) -> pd.Series:
    """Unpack zlib payloads; what cannot be unpacked is null and counts as rejected."""

    def one(data: bytes | None) -> str | None:
        try:
            return zlib.decompress(data).decode() if data is not None else None
        except (zlib.error, UnicodeDecodeError):
            return None

    return blob.map(one)


def decoded_payloads(raw: DataFrame, blob: str = "payload") -> DataFrame:
    """Raw parts (zlib JSON) as vehicle, trip and one row per fix; a part without fixes keeps one row."""
    parsed = raw.withColumn("p", F.from_json(inflated(blob), PAYLOAD))
    rows = parsed.select(*[c for c in raw.columns if c != blob], "p.vehicle", "p.trip", F.explode_outer("p.gps").alias("fix"))
    return rows.select("*", "fix.*").drop("fix").withColumn("ts", parsed_timestamp(F.col("ts")))


def sections(text: str) -> Iterator[dict]:
    """The JSON objects of an export that mixes text and JSON: every balanced container that parses."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        starts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not starts:
            return
        try:
            value, at = decoder.raw_decode(text, min(starts))
        except ValueError:
            at = min(starts) + 1
            continue
        yield from (x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, body): one row per JSON object found in each text export."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(file, k, json.dumps(x)) for file, text in zip(frame["file"], frame["value"]) for k, x in enumerate(sections(text or ""))]
            yield pd.DataFrame(rows, columns=["file", "section", "body"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return texts.mapInPandas(parse, "file string, section int, body string")


def with_roles(df: DataFrame) -> DataFrame:
    """Rename the columns whose header is known; of several for one role the first wins."""
    found: dict[str, str] = {}
    for role, names in HEADERS.items():
        for column in df.columns:
            if column.strip().lower() in names and role not in found.values() and column not in found:
                found[column] = role
    return df.select([F.col(f"`{c}`").alias(r) for c, r in found.items()])


def read_csv_fixes(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Fixes from CSV files with any known header, as text first and cast with tolerance; rows without place or time are marked."""
    raw = with_roles(spark.read.csv(path, header=True, encoding=encoding))
    typed = raw.select(
        cleaned(F.col("vehicle")).alias("vehicle"),
        parsed_timestamp(F.col("ts")).alias("ts"),
        *[parsed_float(F.col(c)).alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "speed")],
    )
    bad = F.when(F.col("ts").isNull(), "no_time").when(F.col("lat").isNull() | F.col("lon").isNull(), "no_place")
    bad = bad.when((F.col("lat") == 0) & (F.col("lon") == 0), "zero_island").when((F.abs("lat") > 90) | (F.abs("lon") > 180), "out_of_range")
    return typed.withColumn("reject", bad)


def rings(vertices: DataFrame, key: str = "site") -> DataFrame:
    """Vertex rows (key, seq, lat, lon) as one ordered ring per key; fewer than three corners are rejected."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon")))
    return vertices.groupBy(key).agg(ring.alias("ring")).withColumn("reject", F.when(F.size("ring") < 3, "too_few_corners"))


def read_regions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, ring) from a GeoJSON layer of polygons; outer rings only."""
    layer = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f"))
    outer = F.transform(F.element_at(F.col("f.geometry.coordinates"), 1), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    return layer.select(F.col(f"f.properties.{name}").alias("name"), outer.alias("ring"))
