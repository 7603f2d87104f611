"""Scalar functions of telemetry feeds as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value" in feeds.
NA_TOKENS = ("", "-", "--", "na", "n/a", "nan", "none", "null", "nil")
#: Mean radius of the earth in metres.
EARTH_M = 6_371_008.8
#: Formats of feed timestamps, tried in this order.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd-MMM-yyyy HH:mm", "dd MMM yyyy HH:mm",
)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def cleaned(c: Column) -> Column:
    """Trimmed text, null where it stands for no value."""
    return F.when(F.lower(F.trim(c)).isin(*NA_TOKENS), None).otherwise(F.trim(c))


def first_known(*columns: Column) -> Column:
    """The first of alternative fields that holds a value."""
    return F.coalesce(*[cleaned(c) for c in columns])


def folded(c: Column) -> Column:
    """Case and white space folded, for keys and grouping."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def parsed_timestamp(c: Column) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS])


def parsed_float(c: Column) -> Column:
    return F.regexp_replace(cleaned(c), "[,%]", "").try_cast("double")


def parsed_int(c: Column) -> Column:
    return F.try_divide(parsed_float(c), F.lit(1)).try_cast("long")


def duration_minutes(c: Column) -> Column:
    """Minutes of "1 Days 05:36", "14:29" or "1 Day 4 Hours 16 Minutes 12 Seconds"; seconds are dropped."""
    part = lambda pattern: F.regexp_extract(F.lower(c), pattern, 1).try_cast("long")
    days = F.coalesce(part(r"(\d+)\s*days?"), F.lit(0))
    clock = F.regexp_extract(c, r"(\d+):(\d+)", 1).try_cast("long") * 60 + F.regexp_extract(c, r"(\d+):(\d+)", 2).try_cast("long")
    words = F.coalesce(part(r"(\d+)\s*hours?"), F.lit(0)) * 60 + F.coalesce(part(r"(\d+)\s*minutes?"), F.lit(0))
    return F.when(c.rlike(r"\d"), days * 1440 + F.coalesce(clock, words))


def delivery_delta_minutes(c: Column) -> Column:
    """Signed minutes: early and before count down."""
    return F.when(F.lower(c).rlike("before|early"), -duration_minutes(c)).otherwise(duration_minutes(c))


def party_name(c: Column) -> Column:
    """A name without the code in brackets behind it; a code holds a digit."""
    return F.trim(F.regexp_replace(c, r"\(\s*[A-Za-z]*\d[A-Za-z0-9]*\s*\)\s*$", ""))


def party_code(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\(\s*([A-Za-z]*\d[A-Za-z0-9]*)\s*\)\s*$", 1), F.lit(""))


def status_speed(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), r"moving\s+(\d+)", 1), F.lit("")).cast("int")


def status_moving(c: Column) -> Column:
    return F.when(F.lower(c).rlike(r"moving\s+\d+"), 1).when(F.lower(c).contains("stopped"), 0)


def first_rule(c: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Ordered keyword classification: the first rule with a keyword inside the text wins."""
    out = None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, [F.upper(c).contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def first_word_rule(c: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The same on whole words."""
    out = None
    for name, words in rules:
        hit = F.upper(c).rlike("(?<![A-Z0-9])(" + "|".join(words) + ")(?![A-Z0-9])")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def flat_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance: good for short legs and cheap."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_M * F.hypot(x, F.radians(lat2 - lat1))


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against an array of structs (lat, lon); half-open, so a shared edge belongs to one ring."""
    n = F.size(ring)
    crossed = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(
            (F.get(ring, i)["lat"] > lat) != (F.get(ring, (i + 1) % n)["lat"] > lat),
            lon
            < (F.get(ring, (i + 1) % n)["lon"] - F.get(ring, i)["lon"])
            * (lat - F.get(ring, i)["lat"])
            / F.nullif(F.get(ring, (i + 1) % n)["lat"] - F.get(ring, i)["lat"], F.lit(0.0))
            + F.get(ring, i)["lon"],
        ).otherwise(F.lit(False)),
    )
    return F.size(F.filter(crossed, lambda x: x)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed shoelace area in squared units of the coordinates; positive if counter-clockwise in (lon, lat)."""
    n = F.size(ring)
    twice = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(ring, i)["lon"] * F.get(ring, (i + 1) % n)["lat"] - F.get(ring, (i + 1) % n)["lon"] * F.get(ring, i)["lat"],
    )
    return F.aggregate(twice, F.lit(0.0), lambda a, b: a + b) / 2


def spelt_out(c: Column, names: dict[str, str]) -> Column:
    """Codes by their names; a text that is no code stays."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, c), c)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def on_time_flag(told: Column, delay: Column) -> Column:
    """1 or 0 as the feed says it, else by the sign of the delay; null if neither is known."""
    return F.coalesce(told, F.when(delay < 0, 1).when(delay >= 0, 0))


def metres_to_degrees(metres: Column, lat: Column) -> Column:
    """(lat, lon) padding of a box in degrees."""
    one = F.lit(EARTH_M) * F.radians(F.lit(1.0))
    return F.struct((metres / one).alias("lat"), (metres / (one * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))).alias("lon"))


def closed_ring(ring: Column) -> Column:
    """Corners that repeat the one before them dropped, the first one repeated at the end."""
    kept = F.filter(ring, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(ring, i - 1)))
    open_ = F.when(F.element_at(kept, -1).eqNullSafe(F.get(kept, F.lit(0))), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
    return F.concat(open_, F.slice(open_, 1, 1))


def ring_wkt(ring: Column) -> Column:
    corners = F.transform(closed_ring(ring), lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(corners, ", "), F.lit("))"))


def distance_to_ring_m(lat: Column, lon: Column, ring: Column) -> Column:
    """Metres from a point to the nearest edge of a ring, in a flat frame around the point."""
    n, metre = F.size(ring), F.lit(EARTH_M) * F.radians(F.lit(1.0))
    wide = metre * F.cos(F.radians(lat))

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return F.struct(
            ((a["lon"] - lon) * wide).alias("x"), ((a["lat"] - lat) * metre).alias("y"), ((b["lon"] - a["lon"]) * wide).alias("dx"), ((b["lat"] - a["lat"]) * metre).alias("dy")
        )

    def nearest(e: Column) -> Column:
        along = F.coalesce(F.try_divide(-(e["x"] * e["dx"] + e["y"] * e["dy"]), e["dx"] * e["dx"] + e["dy"] * e["dy"]), F.lit(0.0))
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)).alias("t"), e.alias("e"))

    points = F.transform(F.transform(F.sequence(F.lit(0), n - 1), edge), nearest)
    return F.array_min(F.transform(points, lambda p: F.hypot(p["e"]["x"] + p["t"] * p["e"]["dx"], p["e"]["y"] + p["t"] * p["e"]["dy"])))


def signed_distance_m(lat: Column, lon: Column, ring: Column) -> Column:
    """Negative inside."""
    far = distance_to_ring_m(lat, lon, ring)
    return F.when(point_in_ring(lat, lon, ring), -far).otherwise(far)


def adaptive_band(inradius_m: Column, widest: float = 25.0, least: float = 5.0, share: float = 0.5) -> Column:
    """The band of a zone: narrower in small zones, never wider than they are; the widest where the size is not known."""
    band = F.least(F.lit(widest), F.greatest(F.lit(least), share * inradius_m), 0.8 * inradius_m)
    return F.when(inradius_m.isNull(), widest).otherwise(F.greatest(F.lit(0.5), band))


def cell_timestamp(c: Column) -> Column:
    """A cell of a sheet: a serial day of spreadsheets (from 1899-12-30, plausible ones only), else a text in a known format."""
    serial = c.try_cast("double")
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")).cast("timestamp_ntz")
    return F.when(serial.between(20_000, 80_000), day).otherwise(F.when(serial.isNull(), parsed_timestamp(c)))


def clock_minutes(c: Column) -> Column:
    """Minutes of "hh:mm", or of a share of the day."""
    clock = F.regexp_extract(c, r"^(\d+):(\d+)", 1).try_cast("long") * 60 + F.regexp_extract(c, r"^(\d+):(\d+)", 2).try_cast("long")
    return F.coalesce(clock, F.round(c.try_cast("double") * 1440).cast("long"))


def encoded_steps(step: Column) -> Column:
    """Whole steps of up to 34 bits in the text code of polylines: sign in the lowest bit, groups of five bits, the low ones first."""
    z = F.when(step < 0, -2 * step - 1).otherwise(2 * step).cast("long")
    rest = [F.shiftright(z, 5 * i) for i in range(8)]
    group = [F.chr(63 + rest[i].bitwiseAND(31) + F.when(rest[i + 1] > 0, 32).otherwise(0)) for i in range(7)]
    return F.concat(group[0], *[F.when(rest[i] > 0, group[i]).otherwise("") for i in range(1, 7)])
