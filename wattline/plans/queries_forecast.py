"""Future index, projection, bands and what-if queries."""

from pyspark.sql import functions as F

from wattline.operators import forecast, reports
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views

FUTURE_SQL = """
    t as (select series_id, epoch_us(ts) as t, row_number() over (partition by series_id order by ts desc) as rn from {source}),
    g as (select series_id, t, t - lead(t) over (partition by series_id order by rn) as gap, rn from t where rn <= 10),
    fr as (select series_id, max(t) as last_t,
                 case when count(*) >= 3 and min(gap) = max(gap) and min(gap) > 0 then min(gap) else 3600000000 end as freq_us
          from g group by series_id),
    fut as (select series_id, step, make_timestamp(last_t + step * freq_us) as ts
            from (select *, cast(unnest(generate_series(1, {h})) as integer) as step from fr))"""


def future(source, h):
    return FUTURE_SQL.format(source=source, h=h)


@query("infer_frequency", with_views("meter_readings", future("meter_readings", 1) + """
    select series_id, make_timestamp(last_t) as last_ts, freq_us from fr"""))
def infer_frequency(spark, sf_dir):
    return forecast.infer_frequency(views.meter_readings(spark, sf_dir))


@query("future_index", with_views("load_by_type", future("load_by_type", 168) + "select series_id, step, ts from fut"))
def future_index(spark, sf_dir):
    return forecast.future_index(views.load_by_type(spark, sf_dir), 168)


@query("future_index_daily", with_views("orders_daily", future("orders_daily", 30) + "select series_id, step, ts from fut"))
def future_index_daily(spark, sf_dir):
    return forecast.future_index(views.orders_daily(spark, sf_dir), 30)


PROFILE_SQL = """
    prof as (select series_id, cast(isodow(ts) - 1 as integer) as dow, cast(hour(ts) as integer) as hour,
                    avg(click) as click, avg("view") as "view" from load_exog group by 1, 2, 3)"""


@query("exog_profile", with_views("load_exog", PROFILE_SQL + """
    select series_id, dow, hour, round(click, 4) as click, round("view", 4) as "view" from prof"""))
def exog_profile(spark, sf_dir):
    out = forecast.exog_profile(views.load_exog(spark, sf_dir), ["click", "view"])
    return out.withColumns({c: F.round(c, 4) for c in ("click", "view")})


@query("future_exog", with_views("load_exog", future("load_exog", 168) + "," + PROFILE_SQL + """,
    l as (select series_id, max_by(click, ts) as lc, max_by("view", ts) as lv from load_exog group by series_id)
    select f.series_id, step, ts, round(coalesce(click, lc), 4) as click, round(coalesce("view", lv), 4) as "view"
    from fut f join l using (series_id)
    left join prof p on p.series_id = f.series_id and p.dow = isodow(ts) - 1 and p.hour = hour(ts)"""))
def future_exog(spark, sf_dir):
    out = forecast.future_exog(views.load_exog(spark, sf_dir), 168, ["click", "view"])
    return out.withColumns({c: F.round(c, 4) for c in ("click", "view")})


def as_forecast(spark, sf_dir):
    """The hourly loads read as a forecast; each part of a day is one horizon."""
    label = F.when(F.hour("ts") < 8, "24h").when(F.hour("ts") < 16, "7d").otherwise("30d")
    loads = views.load_by_type(spark, sf_dir).withColumnRenamed("y", "forecast")
    return forecast.with_bands(loads.withColumn("horizon", label))


HORIZON_SQL = "case when hour(ts) < 8 then '24h' when hour(ts) < 16 then '7d' else '30d' end"


@query("forecast_bands", with_views("load_by_type", f"""
    select series_id, ts, {HORIZON_SQL} as horizon, y as forecast, y * 0.9::double as lower_bound, y * 1.1::double as upper_bound from load_by_type"""))
def forecast_bands(spark, sf_dir):
    return as_forecast(spark, sf_dir)


@query("horizon_table", with_views("load_by_type", f"""
    select series_id, {HORIZON_SQL} as horizon, count(*) as points, round(avg(y), 4) as avg_forecast, min(y) as min_forecast,
           max(y) as max_forecast, max(y * 1.1::double) as peak_load from load_by_type group by 1, 2"""))
def horizon_table(spark, sf_dir):
    return reports.horizon_table(as_forecast(spark, sf_dir)).withColumn("avg_forecast", F.round("avg_forecast", 4))


@query("next_day_slice", with_views("load_by_type", f"""
    select series_id, ts, y as forecast from (
        select *, row_number() over (partition by series_id order by ts) as rn from load_by_type) where rn <= 24"""))
def next_day_slice(spark, sf_dir):
    from wattline.operators.ordering import head

    return head(as_forecast(spark, sf_dir).select("series_id", "ts", "forecast"), 24)


WHAT_IF = """
    m as (select series_id, round(avg(y)) as mean_y from load_by_type group by series_id),
    sim as (select l.series_id, ts, y as base_load, greatest(0.0, round(
                y - case when y > mean_y then (y - mean_y) * cast(0.2 as double) else 0.0 end
                  - case when hour(ts) between 8 and 18 then y * cast(0.1 as double) else 0.0 end
                  - y * cast(0.05 as double))) as simulated_load
            from load_by_type l join m using (series_id))"""


@query("what_if", with_views("load_by_type", WHAT_IF + "select * from sim"))
def what_if(spark, sf_dir):
    return forecast.what_if(as_forecast(spark, sf_dir), peak_shaving=20, solar_shift=10, grid_opt=5)


@query("what_if_totals", with_views("load_by_type", WHAT_IF + """
    select series_id, sum(base_load - simulated_load) as total_offset,
           greatest(0.0, max(base_load) - max(simulated_load)) as peak_cut,
           sum(base_load - simulated_load) * 85 as savings, sum(base_load - simulated_load) * 420 as carbon
    from sim group by series_id"""))
def what_if_totals(spark, sf_dir):
    return forecast.what_if_totals(
        forecast.what_if(as_forecast(spark, sf_dir), peak_shaving=20, solar_shift=10, grid_opt=5)
    )
