"""Stored readings: scans, listings, look-ups, deletion, append."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wattline.operators.ordering import tail
from wattline.schema import UPLOAD_ORDER
from wattline.sources.csv import ORDER


def append_records(records: DataFrame, path: str) -> None:
    """Append readings, partitioned by series. Rows are clustered by series and month first, so small series share files. The
    clusters are rebalanced to Spark's advisory size, so a month of one series, however large, is written by several tasks."""
    placed = records.withColumn("_month", F.date_trunc("month", "ts")).hint("rebalance", "series_id", "_month").drop("_month")
    placed.write.mode("append").partitionBy("series_id").parquet(path)


def read_records(spark: SparkSession, path: str, owner: str | None = None, *, ordered: bool = False) -> DataFrame:
    """Stored readings, of one owner if named. ``ordered`` asks for their order, which is null for readings that were
    stored without one."""
    df = spark.read.parquet(path)
    if ordered:
        known = [f for f in df.schema.fields if f.name != ORDER]
        df = spark.read.schema(StructType([*known, StructField(ORDER, UPLOAD_ORDER)])).parquet(path)
    df = df.withColumn("series_id", F.col("series_id").cast("string"))
    return df.filter(F.col("series_id") == owner) if owner is not None else df


def scan_owner(
    df: DataFrame, owner: Any, *, key: str = "series_id", ts: str = "ts", limit: int | None = None, newest: bool = False
) -> DataFrame:
    """Rows of one owner in time order, the first ``limit`` if one is given; ``newest`` takes the latest ones."""
    rows = df.filter(F.col(key) == owner)
    if limit is None:
        return rows.orderBy(ts)
    if newest:
        rows = rows.orderBy(F.col(ts).desc()).limit(limit)
    return rows.orderBy(ts).limit(limit)


def as_series(records: DataFrame, *, value: str = "value", limit: int | None = None, ingest_order: str | None = None) -> DataFrame:
    """Records to the canonical frame, all rows or the newest ``limit`` per series, with the order of records if it is named."""
    df = records.select("series_id", "ts", F.col(value).alias("y"), *([ingest_order] if ingest_order else []))
    return df if limit is None else tail(df, limit)


def require_rows(df: DataFrame, message: str = "no energy data found; upload a file first") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def _filtered(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    for name, value in filters.items():
        df = df.filter(F.col(name) == value)
    return df


def listing(df: DataFrame, *, order: str, skip: int = 0, limit: int = 100, **filters: Any) -> DataFrame:
    """One page of the filtered rows in a stated order."""
    return _filtered(df, filters).orderBy(order).offset(skip).limit(limit)


def count_filtered(df: DataFrame, **filters: Any) -> DataFrame:
    return _filtered(df, filters).agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, **filters: Any) -> DataFrame:
    return _filtered(df, filters)


def without_owner(df: DataFrame, owner: Any, *, key: str = "series_id") -> DataFrame:
    return df.filter((F.col(key) != owner) | F.col(key).isNull())


def delete_owner(spark: SparkSession, path: str, owner: str) -> int:
    """Delete one owner's partition from the stored table and return its row count.

    The table is partitioned by owner, so only that directory changes."""
    n = read_records(spark, path, owner).count()
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path, f"series_id={_escape(spark, owner)}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def _escape(spark: SparkSession, value: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
