"""Inexact lookups over the names and codes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.names import near_names, placed_by
from wayfold.plans.catalogue import query
from wayfold.sources.tables import read

_ASKED_SQL = """asked AS (
  SELECT DISTINCT upper(CASE p_partkey % 5 WHEN 0 THEN substr(p_name, 1, p_partkey % 7 + 1) || substr(p_name, p_partkey % 7 + 3)
         WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN 'the ' || p_name WHEN 3 THEN substr(p_name, 1, 3) || 'x' || substr(p_name, 5) || 'y' ELSE p_brand || p_name END) AS asked
  FROM part),
known AS (SELECT DISTINCT upper(p_name) AS known FROM part)"""


@query(f"""WITH {_ASKED_SQL}, pairs AS (
  SELECT asked, known, CASE WHEN contains(' ' || known || ' ', ' ' || asked || ' ') OR contains(' ' || asked || ' ', ' ' || known || ' ') THEN 'contained' ELSE 'spelt' END AS how,
         CAST(levenshtein(asked, known) AS INTEGER) AS distance
  FROM asked CROSS JOIN known WHERE asked NOT IN (SELECT known FROM known)),
good AS (SELECT *, CASE WHEN how = 'contained' THEN abs(length(asked) - length(known)) ELSE distance END AS close FROM pairs WHERE how = 'contained' OR distance <= 2)
SELECT asked, known, CAST(row_number() OVER (PARTITION BY asked ORDER BY how, close, known) AS INTEGER) AS rank, how, distance FROM good QUALIFY rank <= 3""")
def s17_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as others type them, and the known names that were probably meant."""
    part = read(spark, sf_dir, "part")
    n, name = F.col("p_partkey") % 7, F.col("p_name")
    typed = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring(name, F.lit(1), (n + 1).cast("int")), F.substring(name, (n + 3).cast("int"), F.length(name))))
        .when(F.col("p_partkey") % 5 == 1, F.split_part(name, F.lit(" "), F.lit(2)))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("the "), name))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.substring(name, 1, 3), F.lit("x"), F.substring(name, F.lit(5), F.length(name)), F.lit("y")))
        .otherwise(F.concat("p_brand", name))
    )
    return near_names(part.select(typed.alias("name")), part.select(name.alias("name")))


_RANGES_SQL = "ranges AS (SELECT 100 + n_nationkey * 35 AS low, 134 + n_nationkey * 35 + (n_nationkey % 3) * 20 AS high, n_nationkey % 4 AS rank, 'region of ' || n_name AS place FROM nation)"


@query(f"""WITH {_RANGES_SQL}, asked AS (
  SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '  ' || lower(n_name) ELSE 'elsewhere ' || c_custkey END AS town,
         CASE WHEN c_custkey % 10 = 9 THEN 'n/a' ELSE CAST((c_custkey * 7919) % 1000000 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END END AS code
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
coded AS (SELECT *, CASE WHEN regexp_full_match(code, '[0-9]{{6}}(\\..*)?') THEN CAST(substr(code, 1, 3) AS INTEGER) END AS prefix FROM asked),
best AS (SELECT c_custkey, r.place FROM coded JOIN ranges r ON prefix BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rank, low, r.place) = 1)
SELECT c.c_custkey, coalesce('centre of ' || n_name, b.place) AS place, CASE WHEN n_name IS NOT NULL THEN 'name' WHEN b.place IS NOT NULL THEN 'code' END AS found_by
FROM coded c LEFT JOIN nation ON upper(n_name) = upper(trim(town)) LEFT JOIN best b ON b.c_custkey = c.c_custkey""")
def g21_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the name of a town, else by the range that the prefix of a code falls in."""
    nation = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("int")
    ranges = nation.select((100 + k * 35).alias("low"), (134 + k * 35 + (k % 3) * 20).alias("high"), (k % 4).alias("rank"), F.concat(F.lit("region of "), "n_name").alias("place"))
    gazetteer = nation.select(F.col("n_name").alias("name"), F.concat(F.lit("centre of "), "n_name").alias("place"))
    c = F.col("c_custkey")
    town = F.when(c % 3 == 0, F.concat(F.lit("  "), F.lower("n_name"))).otherwise(F.concat(F.lit("elsewhere "), c.cast("string")))
    code = F.when(c % 10 == 9, "n/a").otherwise(F.concat(((c * 7919) % 1_000_000).cast("string"), F.when(c % 2 == 0, ".0").otherwise("")))
    asked = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", town.alias("town"), code.alias("code"))
    return placed_by(asked, "town", "code", gazetteer, ranges).select("c_custkey", "place", "found_by")
