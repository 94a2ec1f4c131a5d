"""Dashboard, listing and chart queries."""

from pyspark.sql import functions as F

from wattline.operators import reports
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views


def meter_values(spark, sf_dir):
    return views.meter_readings(spark, sf_dir).withColumnRenamed("y", "value")


@query("dashboard_stats", with_views("meter_readings", """
    select series_id, count(*) as total_records, min(ts) as date_range_start, max(ts) as date_range_end,
           round(avg(y), 2) as avg_consumption, max(y) as max_consumption, min(y) as min_consumption
    from meter_readings group by series_id"""))
def dashboard_stats(spark, sf_dir):
    return reports.dashboard_stats(meter_values(spark, sf_dir))


@query("dashboard_stats_oldest", with_views("meter_readings", """
    r as (select *, row_number() over (partition by series_id order by ts) as rn from meter_readings)
    select series_id, count(*) as total_records, min(ts) filter (where rn <= 30) as date_range_start,
           max(ts) filter (where rn <= 30) as date_range_end, round(avg(y) filter (where rn <= 30), 2) as avg_consumption,
           max(y) filter (where rn <= 30) as max_consumption, min(y) filter (where rn <= 30) as min_consumption
    from r group by series_id"""))
def dashboard_stats_oldest(spark, sf_dir):
    """Statistics over the oldest rows only, the count over all."""
    return reports.dashboard_stats(meter_values(spark, sf_dir), first_n=30)


# Orders stand in for stored recommendations: one row each with a priority class.
PRIORITY_SQL = """case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'HIGH'
         when o_orderpriority = '3-MEDIUM' then 'MEDIUM' else 'LOW' end"""


def order_priorities(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    level = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    )
    return orders.select(
        F.col("o_custkey").cast("string").alias("series_id"), level.alias("priority"), F.col("o_orderkey").alias("rule_no"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "O").alias("is_active"),
    )


@query("priority_counts", f"""
    with r as (select cast(o_custkey as varchar) as series_id, {PRIORITY_SQL} as priority from orders)
    select series_id, count(*) as total, count(*) filter (where priority = 'HIGH') as high_priority,
           count(*) filter (where priority = 'MEDIUM') as medium_priority, count(*) filter (where priority = 'LOW') as low_priority
    from r group by series_id""")
def priority_counts(spark, sf_dir):
    return reports.priority_counts(order_priorities(spark, sf_dir))


@query("top_recommendations", f"""
    with r as (select cast(o_custkey as varchar) as series_id, {PRIORITY_SQL} as priority, o_orderkey as rule_no, o_orderdate as created_at
               from orders where o_orderstatus = 'O')
    select series_id, priority, rule_no, created_at from r
    qualify row_number() over (partition by series_id order by created_at desc, rule_no) <= 5""")
def top_recommendations(spark, sf_dir):
    return reports.top_recommendations(order_priorities(spark, sf_dir)).drop("is_active")


@query("forecast_availability", with_views("load_by_type", """
    v as (select series_id, case when hour(ts) < 8 then '24h' when hour(ts) < 16 then '7d' else '30d' end as horizon,
                 date_trunc('day', ts) as created_at from load_by_type),
    l as (select * from v qualify created_at = max(created_at) over (partition by series_id))
    select series_id, string_agg(distinct horizon, ',' order by horizon) as horizons, count(distinct horizon) as n_horizons
    from l group by series_id"""))
def forecast_availability(spark, sf_dir):
    """Horizons present in the newest version of each series."""
    from wattline.sources.results import latest_versions

    loads = views.load_by_type(spark, sf_dir)
    label = F.when(F.hour("ts") < 8, "24h").when(F.hour("ts") < 16, "7d").otherwise("30d")
    versions = loads.select("series_id", label.alias("horizon"), F.date_trunc("day", "ts").alias("created_at"))
    found = F.array_sort(F.collect_set("horizon"))
    out = latest_versions(versions).groupBy("series_id").agg(found.alias("h"))
    return out.select("series_id", F.array_join("h", ",").alias("horizons"), F.size("h").cast("long").alias("n_horizons"))


@query("system_totals", """
    select (select count(*) from customer) as total_users, (select count(*) from customer where c_acctbal > 0) as active_users,
           (select count(*) from events) as total_energy_records, (select count(*) from orders) as total_recommendations""")
def system_totals(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    return reports.system_totals({
        "total_users": customers,
        "active_users": customers.filter("c_acctbal > 0"),
        "total_energy_records": views.table(spark, sf_dir, "events"),
        "total_recommendations": views.table(spark, sf_dir, "orders"),
    })


@query("upload_totals", """
    with u as (select date_trunc('day', ts) as created_at, event_type as upload_id,
                      count(*) filter (where value >= 5) as rows_valid, count(*) filter (where value < 5) as rows_rejected
               from events group by 1, 2),
    n as (select * from u order by created_at desc, upload_id limit 10)
    select count(*) as uploads, cast(sum(rows_valid) as bigint) as rows_valid, cast(sum(rows_rejected) as bigint) as rows_rejected from n""")
def upload_totals(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    uploads = ev.groupBy(F.date_trunc("day", "ts").alias("created_at"), F.col("event_type").alias("upload_id")).agg(
        F.count_if(F.col("value") >= 5).alias("rows_valid"), F.count_if(F.col("value") < 5).alias("rows_rejected")
    )
    return reports.upload_totals(uploads)


@query("importance_ranked", """
    with i as (select cast(user_id as varchar) as series_id, event_type as feature, sum(round(value * 100)) as mean_abs_shap
               from events group by 1, 2),
    r as (select *, row_number() over (partition by series_id order by mean_abs_shap desc, feature) as rank,
                 round(mean_abs_shap * 100 / max(mean_abs_shap) over (partition by series_id), 1) as normalised from i)
    select series_id, feature, mean_abs_shap, cast(rank as integer) as rank, normalised from r where rank <= 3""")
def importance_ranked(spark, sf_dir):
    ev = views.table(spark, sf_dir, "events")
    importance = ev.groupBy(F.col("user_id").cast("string").alias("series_id"), F.col("event_type").alias("feature")).agg(
        F.sum(views.hundredths("value")).alias("mean_abs_shap")
    )
    return reports.importance_ranked(importance, top=3)
