"""Queries that write files into the shared folder and read them again."""

import uuid

from pyspark.sql import functions as F

from wattline.config import DEFAULTS, replace
from wattline.functions.scalar import clip
from wattline.operators import cleaning, features, metrics
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.plans.queries_models import FEATURE_SQL
from wattline.session import checkpoint_folder, reliable
from wattline.sources import csv, records, results


# Lines of a file that a query writes, about; four files at least.
FILE_ROWS = 1_000_000


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _event_csv(spark, sf_dir):
    """Events as CSV text: a time, a reading that is missing for errors, and the type."""
    path = _folder(spark, "csv")
    ev = views.table(spark, sf_dir, "events")
    ev.select(F.col("ts").cast("string").alias("utc_timestamp"), F.when(F.col("event_type") != "error", F.col("value")).cast("string").alias("load"),
              "event_type", F.col("user_id").cast("string").alias("user")).write.option("header", True).csv(path)
    return path


@query("load_csv", """
    select 'all' as series_id, ts, case when event_type <> 'error' then value end as y, cast(user_id as double) as "user"
    from events where ts <= timestamp '2024-01-20 00:00:00'""")
def load_csv(spark, sf_dir):
    """Time, target and an exogenous column of a CSV file, cut to a date range."""
    cfg = replace(DEFAULTS, start_date="2024-01-01", end_date="2024-01-20")
    out = csv.load(spark, _event_csv(spark, sf_dir), target="load", exog=["user"], cfg=cfg)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("load_supplementary", "select event_type, count(*) as n from events group by 1")
def load_supplementary(spark, sf_dir):
    return csv.load_supplementary(spark, _event_csv(spark, sf_dir), ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("upload_file", """
    select count(*) as rows_loaded, count(case when event_type <> 'error' then value end) as rows_valid,
           'Target column not found; using ''load'' as target.' as warnings,
           count(case when event_type <> 'error' then value end) as stored, round(sum(case when event_type <> 'error' then round(value * 100) end), 0) as total
    from events""")
def upload_file(spark, sf_dir):
    """A CSV file without the target goes to the stored table; its first column of numbers is taken."""
    stored = _folder(spark, "stored")
    summary = csv.upload_file(spark, _event_csv(spark, sf_dir), stored, owner="owner-1")
    kept = records.read_records(spark, stored, "owner-1").agg(F.count(F.lit(1)).alias("stored"), F.round(F.sum(F.round(F.col("value") * 100)), 0).alias("total"))
    row = kept.first()  # two numbers
    return summary.select("rows_loaded", "rows_valid", F.array_join("warnings", ",").alias("warnings"),
                          F.lit(row["stored"]).cast("long").alias("stored"), F.lit(row["total"]).alias("total"))


def _lines_in_order(spark, sf_dir):
    """CSV files whose lines follow the event number; the hour of an event is its time, so times repeat, within and across files."""
    path = _folder(spark, "lines")
    ev = views.table(spark, sf_dir, "events")
    lines = ev.repartitionByRange(max(4, ev.count() // FILE_ROWS), "event_id").sortWithinPartitions("event_id")
    lines.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").cast("string").alias("utc_timestamp"), views.hundredths("value").cast("string").alias("load"),
                 F.col("event_id").cast("string").alias("number")).write.option("header", True).csv(path)
    return path


def _small_splits(spark, build):
    """The rows of ``build()``, written while a file is read in splits of 16 KB, so that a file is the work of several tasks."""
    names = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        return reliable(build())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


FIRST_SQL = """
    select 'all' as series_id, date_trunc('hour', ts) as ts, arg_min(round(value * 100), event_id) as y, min(event_id)::double as number from events"""


@query("csv_keep_first", FIRST_SQL + " group by 2")
def csv_keep_first(spark, sf_dir):
    """Of the lines of an hour, the first in the files stays, whichever task read it."""
    path, cfg = _lines_in_order(spark, sf_dir), replace(DEFAULTS, end_date="2030-01-01")

    def build():
        lines = csv.load(spark, path, target="load", exog=["number"], ingest_order=csv.ORDER, cfg=cfg)
        return cleaning.clean(lines, ingest_order=csv.ORDER, winsorized=False, cfg=replace(cfg, missing_strategy="drop"))

    return _small_splits(spark, build).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("csv_row_cap", "select min(number) as first, max(number) as last, count(*) as n_rows from (select event_id::double as number from events order by event_id limit 700)")
def csv_row_cap(spark, sf_dir):
    """The row cap takes the first lines of the files."""
    path, cfg = _lines_in_order(spark, sf_dir), replace(DEFAULTS, end_date="2030-01-01")
    lines = _small_splits(spark, lambda: csv.load(spark, path, target="load", exog=["number"], max_rows=700, ingest_order=csv.ORDER, cfg=cfg))
    return lines.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("n_rows"))


@query("upload_keep_first", FIRST_SQL.replace("'all'", "'owner-1'").replace(", min(event_id)::double as number", "") + " group by 2")
def upload_keep_first(spark, sf_dir):
    """The same file is uploaded twice, the second time with other readings; stored records keep the first line of the first upload."""
    path, stored = _lines_in_order(spark, sf_dir), _folder(spark, "stored")
    other = _folder(spark, "lines")
    csv.read_text_columns(spark, path).withColumn("load", F.lit("-1")).write.option("header", True).csv(other)
    for name in (path, other):
        csv.upload_file(spark, name, stored, owner="owner-1", target="load")
    series = records.as_series(records.read_records(spark, stored, "owner-1", ordered=True), ingest_order=csv.ORDER)
    kept = cleaning.dedup_first(series, ingest_order=csv.ORDER).drop(csv.ORDER)
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("feature_sink", with_views("load_by_type", FEATURE_SQL + "select series_id, count(*) as n_rows, 40::bigint as n_columns from feat group by 1"))
def feature_sink(spark, sf_dir):
    path = _folder(spark, "features")
    results.write_features(features.transform(views.load_by_type(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    return back.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(back.columns)).cast("long"))


@query("result_sinks", with_views("load_by_type", """
    select 'tables' as sink, series_id, count(*) as n_rows, max(y) as top from load_by_type group by 1, 2
    union all select 'json', series_id, count(*), max(y) from load_by_type group by 1, 2"""))
def result_sinks(spark, sf_dir):
    """Named results as tables and as JSON lines."""
    folder, loads = _folder(spark, "results"), views.load_by_type(spark, sf_dir)
    results.write_results({"loads": loads}, folder)
    results.write_json(loads, f"{folder}/json")
    parts = {"tables": spark.read.parquet(f"{folder}/loads"), "json": spark.read.schema(loads.schema).json(f"{folder}/json")}
    one, two = (df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("y").alias("top")).select(F.lit(n).alias("sink"), "series_id", "n_rows", "top")
                for n, df in parts.items())
    return one.unionByName(two)


@query("clipped", "select event_id, least(greatest(round(value * 100), 500.0), 5000.0) as y from events")
def clipped(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", clip(views.hundredths("value"), 500.0, 5000.0).alias("y"))


@query("event_split", """
    p as (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events)
    select event_id, case when i < n - cast(floor(n * 0.2) as bigint) then 'train' else 'test' end as split from p""".replace("\n    p as", "with p as", 1))
def event_split(spark, sf_dir):
    """Chronological split of all events as one series, by range partitions."""
    ev = views.table(spark, sf_dir, "events").select(F.lit("all").alias("series_id"), F.struct("ts", "event_id").alias("at"), "event_id")
    return metrics.time_split(ev, ts="at", plan="chunked").select("event_id", "split")
