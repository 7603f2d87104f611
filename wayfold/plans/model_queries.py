"""Trained models on the trips of the tables, with features as they were known when a trip was booked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import regressions as G
from wayfold.operators.joins import known_by
from wayfold.plans.catalogue import query
from wayfold.sources.shared import staged
from wayfold.sources.tables import micros, read, trips


def booked_features(t: DataFrame) -> DataFrame:
    """Trips with what was known of their route (route_n, route_mean days) and carrier (carrier_n, carrier_mean on time) when they were booked."""
    timed = t.withColumns({"booked_us": micros("booked"), "ended_us": micros("ended")})
    done = timed.where("ended_us is not null")
    route = known_by(timed, done.where("origin is not null and dest is not null"), ["origin", "dest"], "booked_us", "ended_us", "days", "route")
    return known_by(route, done.where("carrier is not null"), ["carrier"], "booked_us", "ended_us", "on_time", "carrier")


def _rounded(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "r2", "mape", "mean_mae")})


@query()
def n01_travel_time_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on the way, by boosted trees over order, calendar, route and carrier; errors on seen and on held-out trips."""
    df = booked_features(trips(spark, sf_dir)).withColumns({"weekday": F.weekday("booked"), "month": F.month("booked")})
    features = ["stops", "qty", "price", "weekday", "month", "origin", "dest", "route_n", "route_mean", "carrier_n", "carrier_mean"]
    # Read by every pass of the training and by the errors; staged, the trips are joined once.
    rows = G.trimmed(staged(df.select("trip", "days", *features), "travel-times"), "days")
    return _rounded(G.errors(G.predicted(G.trained(rows, "trip", features, "days"), rows, features), "trip", "days"))


@query()
def n10_fuel_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Litres by boosted trees over what the physical rule uses without the rule; errors on seen and on held-out trips."""
    mileage = F.lit(4.0) - F.lit(0.01) * F.least("days", F.lit(100)) + F.when(F.col("status") == "F", 0.5).otherwise(0.0)
    df = trips(spark, sf_dir, lanes=False).withColumns({"litres": F.col("qty") * 10 / mileage, "done": (F.col("status") == "F").cast("int")})
    features = ["qty", "days", "done", "stops"]
    rows = G.trimmed(staged(df.select("trip", "litres", *features), "fuel"), "litres")
    return _rounded(G.errors(G.predicted(G.trained(rows, "trip", features, "litres", rounds=25, depth=5), rows, features), "trip", "litres"))


@query()
def n06_client_demand_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a client in its next active month from the four before, for clients with enough of them; held out are clients, not months."""
    months = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("client"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("orders"))
    w = Window.partitionBy("client").orderBy("month")
    lags = {f"lag{i}": F.lag("orders", i).over(w) for i in (1, 2, 3, 4)}
    gap = F.months_between("month", F.lag("month").over(w))
    df = months.withColumns({**lags, "gap": gap, "calendar": F.month("month"), "active": F.row_number().over(w)}).where("active > 4")
    features = ["lag1", "lag2", "lag3", "lag4", "gap", "calendar", "active"]
    return _rounded(G.errors(G.predicted(G.trained(df, "client", features, "orders"), df, features), "client", "orders"))
