"""Uploaded files of fixes in any layout: CSV of any encoding and delimiter, XLSX, JSON; titles above the header; any column order.

A file is opened by one task, which finds encoding, delimiter, header and the columns that matter and gives one row per
line of the file, still as text. What a cell means is decided by Spark, over whole columns: whether days come before
months, times, numbers, and which rows are refused and why. A file that cannot be read is a row with an error; Spark lists no files without a
byte.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import chain, islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers that stand for a role, most specific first, in lower case letters and digits alone.
ROLES = {
    "ts": (
        "dtmessage", "messagedatetime", "messagetime", "gpsdatetime", "gpstime", "gpsdate", "datetime", "timestamp", "devicetime", "packettime",
        "fixtime", "recordedat", "date", "time", "ts", "dt",
    ),
    "lat": ("dlat", "latitude", "lat", "gpslat", "latdeg", "ylat"),
    "lon": ("dlong", "dlon", "longitude", "longitute", "long", "lon", "lng", "gpslong"),
    "speed": ("ispeed", "speedkmph", "speedkmh", "speed", "kmph", "velocity"),
    "asset": ("sassetid", "assetid", "vehicleno", "vehiclenumber", "vehicle", "asset", "registrationno", "regno", "truckno", "deviceid", "imei"),
    "trip": ("itripno", "tripno", "tripnumber", "tripid", "trip"),
}
#: Headers of a date and of a time that stand in columns of their own.
DAY_ONLY, CLOCK_ONLY = ("date", "gpsdate", "messagedate", "fixdate", "dtdate"), ("time", "gpstime", "messagetime", "fixtime", "dttime")
#: Lines above the header at most; lines that a task holds.
TITLES, HELD = 25, 4_000
_CELLS = ("ts", "day", "clock", "lat", "lon", "speed", "asset", "trip")
_RAW = "file string, format string, encoding string, delimiter string, header_row int, roles map<string, string>, error string, row int, " + ", ".join(f"{c} string" for c in _CELLS) + ", blank boolean"
#: Formats of times beside those with slashes, tried in this order.
_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "d-MMM-yyyy H:m:s", "d-MMM-yyyy H:m", "d-MMM-yyyy", "d MMM yyyy H:m:s", "yyyy/M/d H:m:s", "yyyyMMddHHmmss")


def decoded(data: bytes) -> tuple[str, str]:
    """The text of a file and its encoding: by its mark, else UTF-8 if it is that, else the Western code page."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"


def roles_of(headers: list) -> dict[str, int]:
    """Role -> column. A header that is a known one exactly goes first, then one that contains it, longer ones before shorter."""
    keys = [re.sub(r"[^a-z0-9]", "", str(h or "").lower()) for h in headers]
    out: dict[str, int] = {}
    for role, names in ROLES.items():
        exact = ((i, k == n) for n in names for i, k in enumerate(keys))
        part = ((i, n in k) for n in sorted(names, key=len, reverse=True) for i, k in enumerate(keys))
        for i, fits in (*exact, *part):
            if fits and i not in out.values():
                out[role] = i
                break
    day, clock = (next((i for i, k in enumerate(keys) if k in names), None) for names in (DAY_ONLY, CLOCK_ONLY))
    if day is not None and clock is not None and day != clock:
        out |= {"day": day, "clock": clock, "ts": day}
    return out


def header_of(rows: list[list]) -> int | None:
    """The first row, below ``TITLES`` others at most, that names a latitude and a longitude."""
    return next((k for k, row in enumerate(rows[: TITLES + 1]) if {"lat", "lon"} <= roles_of(row).keys()), None)


def _lines(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        to = text.find("\n", at) + 1 or len(text)
        yield text[at:to]
        at = to


def _csv(data: bytes) -> tuple[Callable[[], Iterator[list]], str, str]:
    text, encoding = decoded(data)
    best: tuple[int, int, str] = (0, 0, ",")
    head = text[: 1 << 16]
    for delimiter in (",", ";", "\t", "|"):
        rows = list(csv.reader(_lines(head), delimiter=delimiter))
        best = max(best, (int(header_of(rows) is not None), max((len(r) for r in rows[: TITLES + 2]), default=0), delimiter), key=lambda x: x[:2])
    return lambda: csv.reader(_lines(text), delimiter=best[2]), encoding, best[2]


def _json(data: bytes) -> tuple[Callable[[], Iterator[list]], str, str]:
    """A list of objects, also under a key, or one object a line."""
    text, encoding = decoded(data)
    try:
        found = json.loads(text)
    except ValueError:
        objects = lambda: (x for line in re.finditer(r"[^\r\n]+", text) if line[0].strip() and isinstance(x := json.loads(line[0]), dict))
    else:
        if isinstance(found, dict):
            found = next((v for v in found.values() if isinstance(v, list)), [found])
        objects = lambda: (x for x in found if isinstance(x, dict))
    names = list(dict.fromkeys(k for x in objects() for k in x))
    return lambda: chain([names], ([x.get(k) for k in names] for x in objects())), encoding, ""


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _xlsx(data: bytes) -> tuple[Callable[[], Iterator[list]], str, str]:
    """The cells of the first sheet; days are serial numbers there."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        rows: list[list] = []
        for _, element in ElementTree.iterparse(io.BytesIO(book.read(sheet))):
            if element.tag != f"{_NS}row":
                continue
            rows += [[] for _ in range(int(element.get("r", len(rows) + 1)) - 1 - len(rows))]
            row: list = []
            for cell in element.iter(f"{_NS}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", ""))
                at = len(row) if letters is None else sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1
                row += [None] * (at + 1 - len(row))
                value = cell.findtext(f"{_NS}v")
                if cell.get("t") == "s" and value is not None:
                    row[at] = shared[int(value)]
                elif cell.get("t") == "inlineStr":
                    row[at] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                elif cell.get("t") in ("str", "b", "e"):
                    row[at] = value
                else:
                    row[at] = None if value is None else float(value)
            rows.append(row)
            element.clear()
    return lambda: iter(rows), "", ""


def _cell(value) -> str | None:
    """Numbers are marked, so that a number in a column of times is told from text that looks like one."""
    if value is None or isinstance(value, bool):
        return None
    return f"\x00{value!r}" if isinstance(value, (int, float)) else str(value)


def lines_of(file: str, data: bytes) -> Iterator[tuple]:
    """One tuple of ``_RAW`` per line below the header, or one with an error."""
    kind = "xlsx" if data[:2] == b"PK" else "json" if data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] in (b"{", b"[") else "csv"
    try:
        rows, encoding, delimiter = {"xlsx": _xlsx, "json": _json, "csv": _csv}[kind](data)
        # Read twice and never held: a file that cannot be read to its end gives no lines.
        first, count = list(islice(rows(), TITLES + 1)), sum(1 for _ in rows())
    except (ValueError, KeyError, IndexError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as error:
        yield (file, kind, None, None, None, None, f"unreadable: {type(error).__name__}", None, *[None] * len(_CELLS), None)
        return
    at = header_of(first)
    seen = max(first, key=len, default=[]) if at is None else first[at]
    roles = roles_of(seen)
    missing = [r for r in ("ts", "lat", "lon") if r not in roles]
    if missing or at is None or at + 1 >= count:
        error = f"no column for {', '.join(missing)}; seen: {', '.join(str(h) for h in seen[:25])}" if missing else "no rows below the header"
        yield (file, kind, encoding, delimiter, None, None, error, None, *[None] * len(_CELLS), None)
        return
    named = {role: str(first[at][i]) for role, i in roles.items()}
    for k, row in enumerate(islice(rows(), at + 1, None), at + 2):
        cells = [_cell(row[roles[c]]) if c in roles and roles[c] < len(row) else None for c in _CELLS]
        yield (file, kind, encoding, delimiter, at + 1, named, None, k, *cells, not any(c not in (None, "") for c in row))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files under ``path``, unread: file, format, encoding, delimiter, header_row, roles, error, row, cells."""
    names = [c.split()[0] for c in _RAW.replace("map<string, string>", "map").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"]):
                held: list[tuple] = []
                for line in lines_of(file, bytes(data)):
                    held.append(line)
                    if len(held) == HELD:
                        yield pd.DataFrame(held, columns=names).astype({"row": "Int32", "header_row": "Int32"})
                        held = []
                yield pd.DataFrame(held, columns=names).astype({"row": "Int32", "header_row": "Int32"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, _RAW)


_SLASHED = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?"


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, "^\x00", "")


def number(c: Column) -> Column:
    """The first number of a cell."""
    return F.regexp_extract(F.replace(_plain(c), F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def timestamp(c: Column, day_first: Column) -> Column:
    """A time from a cell: a serial day, seconds or milliseconds if it is a number, else text with slashes by ``day_first``, else a known format."""
    text = F.trim(c)
    digits = F.startswith(c, F.lit("\x00")) | (text.rlike(r"^\d+$") & (F.length(text) != 14))
    n = _plain(c).try_cast("double")
    at = lambda us: F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(us / 1_000_000).cast("decimal(18,6)"))
    numeric = (
        F.when((n > 32_000) & (n < 75_000), at(F.round((n - 25_569) * 86_400_000_000)))
        .when((n > 9.4e8) & (n < 4.1e9), at(F.round(n * 1_000_000)))
        .when((n > 9.4e11) & (n < 4.1e12), at(F.round(n * 1_000)))
    )
    part = lambda i: F.regexp_extract(text, _SLASHED, i).try_cast("int")
    a, b, y = part(1), part(2), part(3)
    y = F.when(y < 100, y + 2_000).otherwise(y)
    clock = [F.coalesce(part(i), F.lit(0)) for i in (4, 5, 6)]
    first = F.when(a > 12, True).when(b > 12, False).otherwise(day_first)
    made = lambda month, day: F.try_make_timestamp_ntz(y, month, day, *clock)
    slashed = F.coalesce(F.when(first, made(b, a)).otherwise(made(a, b)), F.when(first, made(a, b)).otherwise(made(b, a)))
    known = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in _FORMATS], F.regexp_replace(F.replace(text, F.lit("/"), F.lit("-")), "Z$", "").try_cast("timestamp_ntz"))
    return F.when(digits, numeric).when(text.rlike(_SLASHED), slashed).otherwise(known)


def _with_clock(day: Column, clock: Column) -> Column:
    """A day and a time of day: text, or a share of the day; what is neither leaves the day."""
    n = F.when(F.startswith(clock, F.lit("\x00")), _plain(clock).try_cast("double"))
    part = lambda i: F.coalesce(F.regexp_extract(F.trim(clock), r"^(\d{1,2}):(\d{2})(?::(\d{2}))?", i).try_cast("int"), F.lit(0))
    seconds = F.when((n >= 0) & (n < 1), n * 86_400).otherwise(part(1) * 3_600 + part(2) * 60 + part(3))
    return day + F.make_dt_interval(secs=F.coalesce(seconds, F.lit(0)).cast("decimal(18,6)"))


def fixes_of(lines: DataFrame) -> DataFrame:
    """file, row, ts, lat, lon, speed, reject: blank lines go, a line without time or place is marked. Days come first unless more lines of its file say otherwise."""
    body = lines.where("error IS NULL AND NOT blank")
    two = lambda i: F.regexp_extract(F.coalesce("day", "ts"), r"^\s*(\d{1,2})[/-](\d{1,2})[/-]\d{2,4}", i).try_cast("int")
    counts = body.groupBy("file").agg(F.count_if(two(1) > 12).alias("d"), F.count_if((two(1) <= 12) & (two(2) > 12)).alias("m"))
    told = body.join(counts.select(F.col("file").alias("__file"), (F.col("m") <= F.col("d")).alias("day_first")), F.col("file") == F.col("__file"))
    split = F.col("day").isNotNull() & F.col("roles").getItem("clock").isNotNull()
    ts = F.when(split, _with_clock(timestamp(F.col("day"), F.lit(True)), F.col("clock"))).otherwise(timestamp(F.col("ts"), F.col("day_first")))
    lat, lon = number(F.col("lat")), number(F.col("lon"))
    kmph = number(F.col("speed"))
    speed = F.when(kmph.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), kmph))).cast("int"))
    out = told.select("file", "row", ts.alias("ts"), lat.alias("lat"), lon.alias("lon"), speed.alias("speed"), "day_first", _known("asset").alias("asset"), _known("trip").alias("trip"))
    return out.withColumn("reject", F.when(F.col("ts").isNull(), "no timestamp").when(F.col("lat").isNull(), "no latitude").when(F.col("lon").isNull(), "no longitude"))


def _known(c: str) -> Column:
    text = F.trim(F.regexp_replace(_plain(F.col(c)), r"\.0$", ""))
    return F.when(~F.lower(text).isin("", "none", "nan", "null", "-"), F.substring(text, 1, 50))


def file_report(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """One row per file: how it was read, rows, fixes, refused rows, and the asset and trip where the whole file agrees on one."""
    how = lines.groupBy("file").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("format", "encoding", "delimiter", "header_row", "error")], F.count("row").alias("rows"))
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    found = fixes.groupBy("file").agg(F.count_if(F.col("reject").isNull()).alias("fixes"), F.count("reject").alias("refused"), F.first("day_first").alias("day_first"), one("asset"), one("trip"))
    out = how.join(found, "file", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fixes", "refused")})
    return out.withColumn("error", F.coalesce("error", F.when(F.col("fixes") == 0, "no row has a usable time and place")))
