"""Result tables: forecasts, anomalies, importances, recommendations, run metadata."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_forecast_map(points: DataFrame, *, keys: Sequence[str] = ("series_id", "horizon"), ts: str = "ts") -> DataFrame:
    """Forecast points to one ``map<time text, struct>`` per key. A key holds one forecast,
    so at most as many entries as its horizon has steps."""
    entry = F.struct(
        F.col(ts).cast("string").alias("key"),
        F.struct("forecast", "lower_bound", "upper_bound").alias("value"),
    )
    return points.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("forecast_data"))


def from_forecast_map(stored: DataFrame, *, column: str = "forecast_data", ts_type: str = "timestamp_ntz") -> DataFrame:
    rest = [c for c in stored.columns if c != column]
    return stored.select(*rest, F.explode(column).alias("_ts", "_v")).select(
        *rest, F.col("_ts").cast(ts_type).alias("ts"), "_v.forecast", "_v.lower_bound", "_v.upper_bound"
    )


def latest_versions(versions: DataFrame, *, keys: Sequence[str] = ("series_id",), created: str = "created_at") -> DataFrame:
    """Rows of the newest version per key. Publishing only appends; what is latest is
    derived, so there is no update to lose. The newest time per key is a map-side
    combined aggregate and the join back is on that small table."""
    newest = versions.groupBy(*keys).agg(F.max(created).alias(created))
    return versions.join(newest, [*keys, created], "left_semi")


def with_latest_flag(versions: DataFrame, *, keys: Sequence[str] = ("series_id",), created: str = "created_at", flag: str = "is_latest") -> DataFrame:
    newest = versions.groupBy(*keys).agg(F.max(created).alias("_newest"))
    return versions.join(newest, list(keys), "left").withColumn(flag, F.col(created) == F.col("_newest")).drop("_newest")


VERSION_LOG = "version long, run_id string, folder string"


def publish(df: DataFrame, path: str, *, run_id: str) -> int:
    """Publish one run's rows as a new version, and return its number.

    Rows are written whole to a folder of their own, which nobody reads yet. Then one entry with the next free number is put into the log
    in a single step that fails if another publisher was faster, who then has that number, and the next one is tried. So a version is there entirely or
    not at all, and versions have one order. Publishing a run again replaces its rows: once the new version is there, the old folder goes."""
    spark = df.sparkSession
    folder = f"folder={uuid.uuid4().hex}"
    df.withColumns({"run_id": F.lit(run_id), "created_at": F.current_timestamp()}).write.parquet(f"{path}/{folder}")
    number = max(_published(spark, path), default=0)
    while True:
        number += 1
        entry = json.dumps({"version": number, "run_id": run_id, "folder": folder.partition("=")[2]})
        if _put_new(spark, f"{path}/_log/{number:020d}.json", entry):
            break
    for earlier in _log(spark, path).filter((F.col("run_id") == run_id) & (F.col("version") < number)).select("folder").collect():  # versions of one run
        at, system = _hadoop(spark, f"{path}/folder={earlier['folder']}")
        system.delete(at, True)
    return number


def _published(spark: SparkSession, path: str) -> list[int]:
    """Numbers in the log."""
    log, system = _hadoop(spark, f"{path}/_log")
    return [int(f.getPath().getName().partition(".")[0]) for f in system.listStatus(log) if f.getPath().getName()[:1].isdigit()] if system.exists(log) else []


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSION_LOG).json(f"{path}/_log/*.json")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in its place by one rename, or do nothing if there is one."""
    at, system = _hadoop(spark, path)
    # names with a dot are neither listed nor read
    temporary = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":  # where a rename would replace the file, a link does not
            os.link(temporary.toUri().getPath(), at.toUri().getPath())
            return True
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(temporary, at, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if system.exists(at):
            return False
        raise
    finally:
        system.delete(temporary, False)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all published versions with their number; of a run that was published again, those of its newest version."""
    if not _published(spark, path):
        raise ValueError(f"nothing is published at {path}")
    counted = _log(spark, path).groupBy("run_id").agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version")).select("folder", "version")
    folders = [r["folder"] for r in counted.collect()]  # one per run
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/folder={f}" for f in folders])
    return rows.withColumn("folder", F.col("folder").cast("string")).join(counted, "folder").drop("folder")


def read_latest(spark: SparkSession, path: str, *, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows of the newest version that has the key."""
    return latest_versions(read_versions(spark, path), keys=keys, created="version")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per named result."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def metadata(metrics: DataFrame, best: DataFrame) -> DataFrame:
    """One row per series: best model and all metrics at 4 decimals as a nested map."""
    rounded = F.struct(*[F.round(m, 4).alias(m) for m in ("rmse", "mae", "mape")])
    nested = metrics.groupBy("series_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("model").alias("key"), rounded.alias("value"))))).alias("metrics")
    )
    return best.select("series_id", F.col("model").alias("best_model")).join(nested, "series_id").withColumn(
        "trained_at", F.current_timestamp()
    )


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
