"""Rewrites of stored tables: upserts, surrogate keys, key-scoped replacement. Sinks on plain Parquet have no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and what of ``old`` it does not replace."""
    return new.unionByName(old.join(new, keys, "left_anti"))


def replace_keys(old: DataFrame, rebuilt: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """An incremental refresh: touched keys are taken from the rebuilt rows, also when they are gone there."""
    return rebuilt.unionByName(old.join(touched, keys, "left_anti"))


def with_surrogates(known: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """``known`` and new names with the ids that follow. New dimension members are few; they alone are numbered in order."""
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    fresh = names.join(known, name, "left_anti").distinct()
    numbered = fresh.withColumn("__rn", F.row_number().over(Window.orderBy(name))).join(F.broadcast(top), how="cross")
    return known.select(name, key).unionByName(numbered.select(name, (F.col("__top") + F.col("__rn")).alias(key)))
