"""Ingestion, stored-record and publishing queries."""

import uuid

from pyspark.sql import functions as F

from wattline.operators import forecast
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.session import checkpoint_folder, reliable
from wattline.sources import csv, records, results


@query("ingest_coerce_range", """
    with t as (
        select case when value < 1 then 'bad' || cast(event_id as varchar) else cast(ts as varchar) end as utc_timestamp,
               case when event_type = 'error' then 'n/a' else cast(value as varchar) end as y
        from events),
    c as (select try_cast(utc_timestamp as timestamp) as ts, try_cast(y as double) as y from t)
    select ts, y from c where ts is not null and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'""")
def ingest_coerce_range(spark, sf_dir):
    """Text columns with some unreadable times and numbers, coerced and cut to a range."""
    ev = views.table(spark, sf_dir, "events")
    text = ev.select(
        F.when(F.col("value") < 1, F.concat(F.lit("bad"), F.col("event_id").cast("string")))
        .otherwise(F.col("ts").cast("string")).alias("utc_timestamp"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("y"),
    )
    out = csv.coerce(text, ts="utc_timestamp", numeric=["y"], start="2024-01-05", end="2024-01-20")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("row_cap", """
    select ts, value as y from (select *, row_number() over (order by ts, event_id) as rn from events) where rn <= 2000""")
def row_cap(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    return csv.first_rows(ev, 2000, order=["ts", "event_id"]).select("ts", F.col("value").alias("y"))


UPLOAD_SQL = "case when event_type = 'error' then null else value end"


def _uploaded(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return ev.select(F.col("ts").alias("timestamp"), value.alias("load"), "event_type")


@query("upload_records", f"""
    select 'owner-1' as series_id, ts, {UPLOAD_SQL} as value, 'MW' as unit, 'events' as source_file
    from events where {UPLOAD_SQL} is not null""")
def upload_records(spark, sf_dir):
    rows, _ = csv.upload(_uploaded(spark, sf_dir), owner="owner-1", source="events")
    return rows


@query("upload_summary", f"""
    select 'events' as filename, count(*) as rows_loaded, count({UPLOAD_SQL}) as rows_valid,
           count(*) - count({UPLOAD_SQL}) as rows_rejected, 'y,event_type' as columns,
           min(ts) as range_start, max(ts) as range_end,
           'Target column not found; using ''load'' as target.' as warnings
    from events""")
def upload_summary(spark, sf_dir):
    _, summary = csv.upload(_uploaded(spark, sf_dir), owner="owner-1", source="events")
    return summary.select(
        "filename", "rows_loaded", "rows_valid", "rows_rejected", F.array_join("columns", ",").alias("columns"),
        F.col("time_range")["start"].cast("timestamp_ntz").alias("range_start"),
        F.col("time_range")["end"].cast("timestamp_ntz").alias("range_end"),
        F.array_join("warnings", ",").alias("warnings"),
    )


@query("owner_scan_topn", "select event_id, ts, user_id, value from events where user_id = 7 order by ts limit 25")
def owner_scan_topn(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return records.scan_owner(ev, 7, key="user_id", limit=25)


@query("owner_scan_newest", "select event_id, ts, user_id, value from events where user_id = 7 order by ts desc limit 25")
def owner_scan_newest(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return records.scan_owner(ev, 7, key="user_id", limit=25, newest=True)


@query("record_series", """
    select series_id, ts, y from (
        select cast(user_id as varchar) as series_id, ts, value as y,
               row_number() over (partition by user_id order by ts desc) as rn from events)
    where rn <= 50""")
def record_series(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts", "value")
    return records.as_series(ev, limit=50)


@query("paged_listing", """
    select event_id, ts, event_type, value from events where event_type = 'click' order by event_id limit 50 offset 100""")
def paged_listing(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return records.listing(ev, order="event_id", skip=100, limit=50, event_type="click")


@query("count_filtered", "select count(*) as n from events where event_type = 'view' and user_id = 7")
def count_filtered(spark, sf_dir):
    return records.count_filtered(views.table(spark, sf_dir, "events"), event_type="view", user_id=7)


@query("point_lookup", "select event_id, ts, user_id, event_type, value from events where event_id = 42")
def point_lookup(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return records.lookup(ev, event_id=42)


@query("delete_owner", """
    select event_type, count(*) as n_rows, count(distinct user_id) as owners from events where user_id <> 7 group by event_type""")
def delete_owner(spark, sf_dir):
    left = records.without_owner(views.table(spark, sf_dir, "events"), 7, key="user_id")
    # distinct owners in two map-side combined steps, without an expand
    per_owner = left.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_owner.groupBy("event_type").agg(F.sum("_n").alias("n_rows"), F.count("user_id").alias("owners"))


@query("latest_publish", """
    with v as (select event_type as series_id, date_trunc('day', ts) as created_at, event_id, value from events)
    select series_id, created_at, event_id, value,
           created_at = max(created_at) over (partition by series_id) as is_latest from v""")
def latest_publish(spark, sf_dir):
    """Every day is one published version of each event type."""
    ev = views.table(spark, sf_dir, "events")
    versions = ev.select(
        F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("created_at"), "event_id", "value"
    )
    return results.with_latest_flag(versions)


@query("latest_versions", """
    with v as (select event_type as series_id, date_trunc('day', ts) as created_at, event_id, value from events)
    select series_id, created_at, event_id, value from v
    qualify created_at = max(created_at) over (partition by series_id)""")
def latest_versions(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    versions = ev.select(
        F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("created_at"), "event_id", "value"
    )
    return results.latest_versions(versions)


@query("forecast_map_roundtrip", with_views("load_by_type", """
    select series_id, strftime(ts, '%Y-%m-%d') as horizon, ts, y as forecast, y * 0.9::double as lower_bound, y * 1.1::double as upper_bound from load_by_type"""))
def forecast_map_roundtrip(spark, sf_dir):
    """Every day of a series is one stored forecast of up to 24 points."""
    points = forecast.with_bands(views.load_by_type(spark, sf_dir).withColumnRenamed("y", "forecast"))
    points = points.withColumn("horizon", F.date_format("ts", "yyyy-MM-dd"))
    return results.from_forecast_map(results.to_forecast_map(points))


@query("atomic_publish", """
    with v as (select event_type as series_id, 1 + least(2, (day(ts) - 1) // 10) as part, round(value * 100) as y from events),
    t as (select series_id, part as version, sum(y) as total, count(*) as n from v where not (part = 3 and series_id = 'view') group by 1, 2)
    select series_id, version::bigint as version, total, n from t qualify version = max(version) over (partition by series_id)""")
def atomic_publish(spark, sf_dir):
    """Three versions of totals by type, of which the last lacks one type; rows without a log entry are not read."""
    path = f"{checkpoint_folder(spark)}/publish-{uuid.uuid4().hex}"
    ev = views.table(spark, sf_dir, "events")
    part = 1 + F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    totals = ev.select(F.col("event_type").alias("series_id"), part.alias("part"), views.hundredths("value").alias("y")).groupBy("series_id", "part").agg(
        F.sum("y").alias("total"), F.count(F.lit(1)).alias("n"))
    totals = reliable(totals.filter("not (part = 3 and series_id = 'view')"))
    for k in (1, 2, 3):
        results.publish(totals.filter(F.col("part") == k).drop("part"), path, run_id=f"run-{k}")
    totals.withColumns({"run_id": F.lit("torn"), "created_at": F.current_timestamp()}).drop("part").write.parquet(f"{path}/folder=torn")
    return results.read_latest(spark, path).select("series_id", "version", "total", "n")
