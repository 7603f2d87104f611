"""What a trail may have passed while it was silent: points laid along the missing leg, zones near them, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import haversine_m
from wayfold.operators.tiles import legs_past
from wayfold.operators.zones import METRE6

#: Metres between the points of a leg; a zone this near to it may have held a stop; seconds that a stop leaves unexplained.
STEP_M, NEAR_M, UNEXPLAINED_S = 25.0, 300.0, 900.0


def moving_silences(fixes: DataFrame, least_us: int, least_m: float) -> DataFrame:
    """Gaps of ``least_us`` or more between whose ends an asset (vehicle) moved: gap, vehicle, from_us, to_us, straight_m and the straight route."""
    w = Window.partitionBy("vehicle").orderBy("us", "event_id")
    before = fixes.select("event_id", "vehicle", "us", "lat6", "lon6", *[F.lag(c).over(w).alias(f"{c}_0") for c in ("us", "lat6", "lon6")])
    degrees = lambda c: F.col(c) * 1e-6
    straight = haversine_m(degrees("lat6_0"), degrees("lon6_0"), degrees("lat6"), degrees("lon6"))
    found = before.where(F.col("us") - F.col("us_0") >= least_us).withColumn("straight_m", straight).where(F.col("straight_m") >= least_m)
    return found.select(
        F.col("event_id").alias("gap"), "vehicle", F.col("us_0").alias("from_us"), F.col("us").alias("to_us"), "straight_m",
        F.array("lat6_0", "lat6").alias("lats"), F.array("lon6_0", "lon6").alias("lons"),
    )


def densified(routes: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """(gap, seq, lat6, lon6, at_mm): points no more than ``step_m`` apart along each route (lats, lons), its corners among them, and how far along they are.

    Generated row by row where the route is read; a route is never gathered again.
    """
    legs = routes.where(F.size("lats") >= 2).select("gap", "lats", "lons", F.explode(F.sequence(F.lit(1), F.size("lats") - 1)).alias("i"))
    at = lambda c, k: F.get(F.col(c), F.col("i") - k)
    flat = legs.select("gap", "i", at("lats", 1).alias("a_lat"), at("lons", 1).alias("a_lon"), at("lats", 0).alias("b_lat"), at("lons", 0).alias("b_lon"))
    wide = F.cos(F.radians((F.col("a_lat") + F.col("b_lat")) * 5e-7))
    flat = flat.withColumn("metres", METRE6 * F.hypot(F.col("b_lat") - F.col("a_lat"), (F.col("b_lon") - F.col("a_lon")) * wide)).where("i = 1 OR metres > 0")
    w = Window.partitionBy("gap").orderBy("i")
    flat = flat.withColumns({"pieces": F.greatest(F.lit(1), F.ceil(F.col("metres") / step_m)).cast("int"), "before_m": F.sum("metres").over(w) - F.col("metres")})
    # The first leg has its first corner too; every other one begins after its own.
    points = flat.withColumn("j", F.explode(F.sequence(F.when(F.col("i") == 1, 0).otherwise(1), F.col("pieces"))))
    share = F.col("j") / F.col("pieces")
    along = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * share).cast("long")
    return points.select("gap", "i", "j", along("a_lat", "b_lat").alias("lat6"), along("a_lon", "b_lon").alias("lon6"), F.round((F.col("before_m") + F.col("metres") * share) * 1_000).cast("long").alias("at_mm"))


def confidence(kind: Column, gap_s: Column, route_m: Column, route_s: Column, straight_m: Column) -> Column:
    """A route that takes longer than the gap, or twice the straight way, is not what happened; short gaps that it explains are sure."""
    detour, unexplained = route_m / F.greatest(straight_m, F.lit(1.0)), gap_s - route_s
    sure = (gap_s <= 1_800) & (detour <= 1.5) & (unexplained <= F.greatest(F.lit(600.0), 0.5 * route_s))
    return (
        F.when((route_s > gap_s * 1.25) | (detour > 2.0), "low")
        .when(kind == "near_stop", F.when(unexplained >= 1_800, "medium").otherwise("low"))
        .when(sure, "high")
        .when(gap_s <= 4 * 3_600, "medium")
        .otherwise("low")
    )


def passages(gaps: DataFrame, zones: DataFrame, visits: DataFrame, near_m: float = NEAR_M, unexplained_s: float = UNEXPLAINED_S, step_m: float = STEP_M) -> DataFrame:
    """Zones that an asset may have passed in its silences.

    ``gaps``: gap, vehicle, from_us, to_us, straight_m, lats, lons, route_m, route_s. A route that clears a zone's band
    inside is a passage through it, with times if it explains the gap; one that comes near it while time is left over may
    have been a stop there. Zones that the asset was seen in at either end of the gap (``visits``) are no finding.
    """
    points = densified(gaps, step_m)
    met = legs_past(points.select("gap", "at_mm", "lat6", "lon6"), zones, 2 * near_m)
    about = met.join(gaps.drop("lats", "lons"), "gap")
    seen = visits.select(F.col("vehicle").alias("v"), F.col("zone").alias("z"), "enter", F.when(~F.col("open"), F.col("leave")).alias("leave"))
    at = lambda c: (F.col("enter") <= F.col(c)) & (F.col("leave").isNull() | (F.col(c) <= F.col("leave")))
    new = about.join(seen, (F.col("vehicle") == F.col("v")) & (F.col("zone") == F.col("z")) & (at("from_us") | at("to_us")), "left_anti")
    gap_s = (F.col("to_us") - F.col("from_us")) / 1_000_000
    unexplained = gap_s - F.col("route_s")
    kind = F.when(F.col("first_mm").isNotNull(), "through").when((F.col("nearest_m") <= near_m) & (unexplained >= unexplained_s), "near_stop")
    told = F.when((unexplained < unexplained_s) & (F.col("route_m") > 0), F.col("route_s") * 1_000 / F.col("route_m"))  # microseconds a millimetre
    when = lambda c: F.least(F.col("from_us") + F.round(told * F.col(c)).cast("long"), F.col("to_us"))
    out = new.withColumn("kind", kind).where("kind IS NOT NULL")
    return out.select(
        "gap", "vehicle", "zone", "kind", "from_us", "to_us", F.when(told.isNotNull(), when("first_mm")).alias("enter_us"), F.when(told.isNotNull(), when("last_mm")).alias("leave_us"),
        F.coalesce((F.col("last_mm") - F.col("first_mm")) / 1_000, F.lit(0.0)).alias("inside_m"), "nearest_m",
        confidence(F.col("kind"), gap_s, F.col("route_m"), F.col("route_s"), F.col("straight_m")).alias("confidence"),
    )
