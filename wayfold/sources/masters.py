"""Masters of circular zones from files of clients: columns by their headers, checks with reasons, and what an import would change."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.scalars import haversine_m
from wayfold.operators.names import name_key, near_names

#: Headers that stand for a field, in lower case letters and digits alone, most specific first.
ALIASES = {
    "name": (
        "name", "node", "nodename", "location", "locationname", "sname", "snodename", "destination", "destinationname", "consignee",
        "consigneename", "site", "sitename", "customer", "customername", "plant", "plantname", "geofencename", "fencename", "place", "placename",
    ),
    "lat": ("lat", "latitude", "lattitude", "dlat", "geolat", "geofencelat", "centerlat", "centrelat", "centerlatitude", "y"),
    "lon": ("lon", "lng", "long", "longitude", "dlong", "geolon", "geolong", "geofencelon", "geofencelong", "centerlon", "centrelon", "centerlongitude", "x"),
    "radius": (
        "radiusm", "radius", "geofenceradius", "geofenceradiusm", "radiusmeters", "radiusmetres", "radiusinmeters", "radiusinmetres", "iradiusm",
        "fenceradius", "buffer", "bufferm",
    ),
    "role": ("role", "type", "srole", "fencetype", "locationtype", "geofencetype", "nodetype", "category"),
}
#: What a header may end with where none is known; never a name, of which a wrong guess would go unseen.
ENDINGS = {"lat": ("latitude", "lat"), "lon": ("longitude", "long", "lng", "lon"), "radius": ("radius",)}
ROLES = ("origin", "destination", "yard")
#: Metres of a radius, and the one that is taken where none is given.
LEAST_M, MOST_M, DEFAULT_M = 50, 50_000, 3_000


def columns_of(headers: list[str]) -> dict[str, str]:
    """Field -> header. Shown to whoever imports, as a guess about a column must not go unseen."""
    folded = {h: re.sub(r"[^a-z0-9]", "", h.lower()) for h in headers}
    out = {}
    for field, names in ALIASES.items():
        exact = (h for n in names for h, k in folded.items() if k == n)
        ending = (h for n in ENDINGS.get(field, ()) for h, k in folded.items() if k.endswith(n))
        found = next(exact, None) or next(ending, None)
        if found is not None:
            out[field] = found
    return out


def checked_circles(rows: DataFrame, box: tuple[float, float, float, float] = (-90.0, -180.0, 90.0, 180.0)) -> DataFrame:
    """(key, name, role, lat, lon, radius_m, reject) of raw rows with any headers. ``box`` (south, west, north, east) holds the area of the client."""
    of = columns_of(rows.columns)
    text = {f: F.nullif(F.trim(F.col(f"`{of[f]}`").cast("string")), F.lit("")) if f in of else F.lit(None).cast("string") for f in ALIASES}
    lat, lon = text["lat"].try_cast("double"), text["lon"].try_cast("double")
    radius = F.when(text["radius"].isNull(), DEFAULT_M).otherwise(text["radius"].try_cast("double").try_cast("int"))
    role = F.lower(F.coalesce(text["role"], F.lit("destination")))
    plain = rows.select(name_key(text["name"]).alias("key"), text["name"].alias("name"), role.alias("role"), lat.alias("lat"), lon.alias("lon"), radius.alias("radius_m"))
    inside = lambda a, b: a.between(box[0], box[2]) & b.between(box[1], box[3])
    y, x = F.col("lat"), F.col("lon")
    reject = (
        F.when(F.col("key").isNull(), "no name")
        .when(y.isNull() | x.isNull() | F.isnan(y) | F.isnan(x), "no place")
        .when(~y.between(-90, 90) | ~x.between(-180, 180), F.when(inside(x, y), "latitude and longitude look swapped").otherwise("out of range"))
        .when(~inside(y, x), F.when(inside(x, y), "latitude and longitude look swapped").otherwise("outside the area"))
        .when(F.col("radius_m").isNull(), "radius is no number")
        .when(~F.col("radius_m").between(LEAST_M, MOST_M), "radius out of bounds")
        .when(~F.col("role").isin(*ROLES), "unknown role")
    )
    return plain.withColumn("reject", reject)


def preview(checked: DataFrame, held: DataFrame, used: DataFrame) -> DataFrame:
    """What importing the good rows of ``checked`` would do: key, role, action, shift_m, unmatched, meant.

    ``held`` has the circles so far (key, role, lat, lon), ``used`` the names that trips use (name). A circle whose name
    no trip uses is stored and never measured against: it comes with the names that were probably meant. Of rows for one
    key and role the last by place counts.
    """
    good = checked.where("reject IS NULL").groupBy("key", "role").agg(F.max(F.struct("lat", "lon", "radius_m")).alias("x")).select("key", "role", "x.*")
    before = held.select("key", "role", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.lit(True).alias("__held")).dropDuplicates(["key", "role"])
    known = used.select(name_key("name").alias("key")).where("key IS NOT NULL").distinct().withColumn("__used", F.lit(True))
    meant = near_names(good.select(F.col("key").alias("name")), used).groupBy(F.col("asked").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "known"))), lambda x: x["known"]), "; ").alias("meant"))
    out = good.join(before, ["key", "role"], "left").join(known, "key", "left").join(meant, "key", "left")
    shift = F.when(F.col("__held"), haversine_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")))
    action = F.when(F.col("__held"), "update").otherwise("insert")
    return out.select("key", "role", "lat", "lon", "radius_m", action.alias("action"), shift.alias("shift_m"), F.col("__used").isNull().alias("unmatched"), "meant")


def imported(held: DataFrame, shown: DataFrame) -> DataFrame:
    """The circles after the import of ``preview``: the client's replace those of the same key and role, the others stay."""
    fresh = shown.select("key", "role", "lat", "lon", "radius_m", F.lit("client").alias("source"))
    return held.select("key", "role", "lat", "lon", "radius_m", "source").join(fresh.select("key", "role"), ["key", "role"], "left_anti").unionByName(fresh)


def read_list(spark, path: str, field: str) -> tuple[DataFrame, DataFrame]:
    """A published list of places as JSON ({"published": day, field: [rows]}): the rows with the day, and the counts of the list. It replaces an older one whole."""
    doc = spark.read.json(path, multiLine=True)
    rows = doc.select(F.col("published").cast("date").alias("as_of"), F.explode(field).alias("x")).select("x.*", "as_of")
    return rows, doc.select(F.col("published").cast("date").alias("as_of"), F.size(field).alias("rows"))
