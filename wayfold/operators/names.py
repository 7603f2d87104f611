"""Inexact lookups: names that were probably meant, and places by name or by the prefix of a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_key(c: Column | str) -> Column:
    """Case and blanks folded; an empty name is none."""
    return F.nullif(F.upper(F.regexp_replace(F.trim(c), r"\s+", " ")), F.lit(""))


def _without(name: Column, edits: int) -> Column:
    """The name and what is left of it without up to ``edits`` letters: names within so many edits share one of these."""
    out = F.array(name)
    for _ in range(edits):
        shorter = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def near_names(asked: DataFrame, known: DataFrame, edits: int = 2, limit: int = 3, least_letters: int = 4) -> DataFrame:
    """(asked, known, rank, how, distance): for each name that is asked for (``name``) and not known the ``limit`` best that are.

    First names of which one holds all words of the other, in order and side by side (``contained``), the closest in
    length first; then those within ``edits`` edits (``spelt``), for names of ``least_letters`` letters or more. Words
    and shortened names are keys of equi-joins and every pair is verified, so no two lists are crossed: contained names
    meet by the rarest word of the shorter one.
    """
    known = known.select(name_key("name").alias("known")).where("known IS NOT NULL").distinct()
    asked = asked.select(name_key("name").alias("asked")).where("asked IS NOT NULL").distinct().join(known.withColumnRenamed("known", "asked"), "asked", "left_anti")
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    known_words, asked_words = words(known, "known"), words(asked, "asked")
    often = known_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    held = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    # A word that no known name has cannot be in the longer of two names.
    rare = asked_words.join(often, "word", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word")).alias("x")).select("asked", F.col("x.word").alias("word"))
    inside = rare.join(known_words, "word").where(held(F.col("asked"), F.col("known"))).select("asked", "known")
    asked_often = asked_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rare = known_words.join(asked_often, "word", "left").groupBy("known").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word")).alias("x")).select("known", F.col("x.word").alias("word"))
    around = rare.join(asked_words, "word").where(held(F.col("known"), F.col("asked"))).select("asked", "known")
    distance = F.levenshtein("asked", "known").cast("int")
    contained = inside.union(around).distinct().select("asked", "known", F.lit("contained").alias("how"), distance.alias("distance"))

    keys = lambda df, c: df.where(F.length(c) >= least_letters).select(c, F.explode(_without(F.col(c), edits)).alias("key"))
    spelt = keys(asked, "asked").join(keys(known, "known"), "key").select("asked", "known").distinct()
    spelt = spelt.select("asked", "known", F.lit("spelt").alias("how"), distance.alias("distance")).where(F.col("distance") <= edits)
    both = contained.unionByName(spelt.join(contained.select("asked", "known"), ["asked", "known"], "left_anti"))
    close = F.when(F.col("how") == "contained", F.abs(F.length("asked") - F.length("known"))).otherwise(F.col("distance"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("how", close, "known"))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit).select("asked", "known", "rank", "how", "distance")


def prefixes(ranges: DataFrame, digits: int) -> DataFrame:
    """Ranges of code prefixes (low, high, rank, place) as single prefixes: of ranges that overlap the first by rank, then low, then place. At most 10 ** digits rows."""
    inside = ranges.where("low <= high").withColumn("prefix", F.explode(F.sequence(F.greatest("low", F.lit(0)), F.least("high", F.lit(10**digits - 1)))))
    return inside.groupBy("prefix").agg(F.min(F.struct("rank", "low", "place")).alias("x")).select("prefix", "x.place")


def placed_by(rows: DataFrame, name: str, code: str, gazetteer: DataFrame, ranges: DataFrame, digits: int = 3, length: int = 6) -> DataFrame:
    """``rows`` with place and how it was found: by name in the gazetteer (name, place), else by the prefix of a code of ``length`` digits, else null.

    Codes may come as numbers with a fraction. The prefixes are at most 10 ** digits rows, so they are sent to all tasks.
    """
    known = gazetteer.select(name_key("name").alias("__name"), "place").where("__name IS NOT NULL").groupBy("__name").agg(F.min("place").alias("__by_name"))
    table = prefixes(ranges, digits).select(F.col("prefix").alias("__prefix"), F.col("place").alias("__by_code"))
    plain = F.regexp_extract(F.trim(F.col(code).cast("string")), rf"^([0-9]{{{length}}})(?:\..*)?$", 1)
    keyed = rows.withColumns({"__key": name_key(name), "__p": F.substring(plain, 1, digits).try_cast("int")})
    found = keyed.join(known, keyed["__key"] == known["__name"], "left").join(F.broadcast(table), F.col("__p") == F.col("__prefix"), "left")
    how = F.when(F.col("__by_name").isNotNull(), "name").when(F.col("__by_code").isNotNull(), "code")
    return found.withColumns({"place": F.coalesce("__by_name", "__by_code"), "found_by": how}).drop("__key", "__p", "__name", "__by_name", "__prefix", "__by_code")
