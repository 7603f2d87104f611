"""Trained regressions: trimmed targets, a split by hash, gradient-boosted trees, and their errors beside those of the mean."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed(rows: DataFrame, target: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose target lies between two quantiles; those without one go."""
    ends = rows.where(F.col(target).isNotNull()).agg(F.percentile_approx(target, [low, high], 10_000).alias("q"))
    return rows.crossJoin(F.broadcast(ends)).where(F.col(target).between(F.get("q", F.lit(0)), F.get("q", F.lit(1)))).drop("q")  # one row


def held_out(key: str) -> Column:
    """One row in five, by the hash of its key, whatever else is there."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def trained(rows: DataFrame, key: str, features: list[str], target: str, rounds: int = 15, depth: int = 4) -> GBTRegressionModel | None:
    """Trees on the rows that are not held out; null features count as -1. None where there is nothing to learn from."""
    seen = _vectors(rows.where(~held_out(key) & F.col(target).isNotNull()), features).select("features", F.col(target).cast("double").alias("label"))
    return None if seen.isEmpty() else GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(seen)


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    known = rows.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    return VectorAssembler(inputCols=[f"__{c}" for c in features], outputCol="features").transform(known).drop(*[f"__{c}" for c in features])


def predicted(model: GBTRegressionModel | None, rows: DataFrame, features: list[str]) -> DataFrame:
    if model is None:
        return rows.withColumn("prediction", F.lit(None).cast("double"))
    return model.transform(_vectors(rows, features)).drop("features")


def errors(scored: DataFrame, key: str, target: str) -> DataFrame:
    """(held_out, n, mae, rmse, r2, mape, mean_mae): ``mean_mae`` is the error of always saying the mean of the rows that were learnt from."""
    y, p = F.col(target).cast("double"), F.col("prediction")
    marked = scored.where(F.col(target).isNotNull() & p.isNotNull()).withColumn("held_out", held_out(key))
    mean = marked.where("NOT held_out").agg(F.avg(y).alias("seen_mean"))
    off = F.abs(y - p)
    sums = marked.crossJoin(F.broadcast(mean)).groupBy("held_out").agg(
        F.count(F.lit(1)).alias("n"), F.avg(off).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"),
        F.try_divide(F.avg(off * off), F.nullif(F.var_pop(y), F.lit(0.0))).alias("__unexplained"),
        F.avg(F.when(y != 0, off / F.abs(y))).alias("mape"), F.avg(F.abs(y - F.col("seen_mean"))).alias("mean_mae"),
    )
    return sums.select("held_out", "n", "mae", "rmse", (1 - F.col("__unexplained")).alias("r2"), "mape", "mean_mae")
