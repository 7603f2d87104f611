"""Uploads: the fixes of the tables, written as files of several layouts and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.catalogue import query
from wayfold.sources.shared import shared_folder
from wayfold.sources.trails import TRAILS_SQL, trails
from wayfold.sources.uploads import file_report, fixes_of, read_lines


#: Lines of a file at most, as senders export by the day or the week; a file is opened by one task.
LINES = 25_000


def _uploaded(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files as four senders would export them: other headers, delimiters, encodings and times."""
    base = shared_folder(spark, "uploads")
    ts = F.timestamp_micros("us")
    lat, lon = (F.format_string("%.6f", F.col(c) / 1e6) for c in ("lat6", "lon6"))
    kmph = F.floor(F.col("speed") / 100)
    df = trails(spark, sf_dir)
    own = lambda k: df.where(F.col("vehicle") % 4 == k)
    own(0).select(F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("GPS Date/Time"), lat.alias("Latitude"), lon.alias("Longitude"), kmph.alias("Speed (km/h)"), F.col("event_id").alias("Trip No")).write.option("maxRecordsPerFile", LINES).csv(f"{base}/a", header=True)
    own(1).select(F.col("event_id").alias("trip"), F.date_format(ts, "dd/MM/yyyy HH:mm:ss").alias("time stamp"), lon.alias("lng"), lat.alias("lat"), kmph.alias("kmph")).write.option("maxRecordsPerFile", LINES).csv(f"{base}/b", header=True, sep=";", encoding="ISO-8859-1")
    own(2).select(F.date_format(ts, "dd-MMM-yyyy").alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"), lat.alias("d_lat"), lon.alias("d_long"), kmph.alias("speed"), F.col("event_id").alias("trip_id")).write.option("maxRecordsPerFile", LINES).csv(f"{base}/c", header=True, sep="\t", encoding="UTF-16")
    own(3).select((F.col("us") / 1_000_000).cast("long").alias("ts"), lat.alias("lat"), lon.alias("lon"), kmph.alias("speed"), F.col("event_id").alias("trip")).write.option("maxRecordsPerFile", LINES).json(f"{base}/d")
    return base


@query(f"WITH {TRAILS_SQL} SELECT event_id, us // 1000000 AS s, lat6, lon6, CAST(greatest(0, least(255, speed // 100)) AS INTEGER) AS speed, CAST(NULL AS VARCHAR) AS reject FROM trails")
def s12_uploaded_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixes through upload files of four layouts and back."""
    found = fixes_of(read_lines(spark, _uploaded(spark, sf_dir)))
    six = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return found.select(F.col("trip").cast("long").alias("event_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), six("lat").alias("lat6"), six("lon").alias("lon6"), "speed", "reject")


@query()
def s10_upload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each file was read: format, encoding, delimiter, header, rows."""
    lines = read_lines(spark, _uploaded(spark, sf_dir)).where("NOT (file LIKE '%/_SUCCESS' OR file LIKE '%.crc')")
    return file_report(lines, fixes_of(lines)).select(F.element_at(F.split("file", "/"), -2).alias("sender"), "format", "encoding", "delimiter", "header_row", "error", "rows", "fixes", "refused", "day_first")
