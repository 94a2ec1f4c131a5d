"""Series views over the given tables.

A reading is in hundredths of the stored value, so sums and means of readings are
exact in double precision and do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100)


def _hour(c: str) -> Column:
    return F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")


def _named(series: str) -> Column:
    """Series name tied to the row: a plain literal would be folded out of join keys."""
    return F.when(F.col("ts").isNotNull(), F.lit(series)).alias("series_id")


def load_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: all events, summed by hour."""
    ev = table(spark, sf_dir, "events")
    out = ev.groupBy(_hour("ts").alias("ts")).agg(F.sum(hundredths("value")).alias("y"))
    return out.select(_named("all"), "ts", "y")


def load_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type, summed by hour; hours without events are absent."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("series_id"), _hour("ts").alias("ts")).agg(
        F.sum(hundredths("value")).alias("y")
    )


def load_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series with two exogenous columns: the click and the view share of the hour."""
    ev = table(spark, sf_dir, "events")
    share = lambda kind: F.sum(F.when(F.col("event_type") == kind, hundredths("value")).otherwise(0.0))
    out = ev.groupBy(_hour("ts").alias("ts")).agg(
        F.sum(hundredths("value")).alias("y"), share("click").alias("click"), share("view").alias("view")
    )
    return out.select(_named("all"), "ts", "y", "click", "view")


def load_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``load_by_type`` on each series' full hour grid; absent hours have a null target."""
    loads = load_by_type(spark, sf_dir)
    grid = loads.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = grid.select("series_id", F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("ts"))
    return grid.join(loads, ["series_id", "ts"], "left")


def load_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stamped with their hour, before aggregation: many rows per timestamp."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("series_id"), _hour("ts").alias("ts"),
        hundredths("value").alias("y"), F.col("event_id").alias("ingest_order"),
    )


def meter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: every event is a reading at its own time."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("series_id"), "ts", hundredths("value").alias("y"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series: order value by order date."""
    orders = table(spark, sf_dir, "orders")
    out = orders.groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum(hundredths("o_totalprice")).alias("y"))
    return out.select(_named("orders"), "ts", "y")
