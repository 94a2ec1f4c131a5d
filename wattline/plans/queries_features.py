"""Calendar, lag, rolling, positional and split queries, and the flagship query."""

import uuid

from pyspark.sql import functions as F

from wattline.config import DEFAULTS, replace
from wattline.operators import anomaly, cleaning, features, limits, metrics, reports
from wattline.operators.ordering import choose_plan, tail
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.plans.queries_cleaning import IQR_CTE
from wattline.session import checkpoint_folder, reliable
from wattline.streaming.limits import sliding_limit_stream

LAGS = DEFAULTS.lags
WINDOWS = DEFAULTS.windows

# Easter Sunday (Gregorian, anonymous algorithm) with every step as a CTE column.
HOLIDAY_SQL = """
    yy as (select distinct year({ts}) as y0 from {source}),
    e1 as (select y0, y0 % 19 as a, y0 // 100 as b, y0 % 100 as c from yy),
    e2 as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from e1),
    e3 as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from e2),
    e4 as (select *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 as o from e3),
    easter as (select y0, make_date(y0, o // 31, o % 31 + 1) as easter from e4)"""

IS_HOLIDAY_SQL = """cast(case when (month({ts}) * 100 + day({ts})) in (101, 501, 1003, 1225, 1226)
         or date_diff('day', easter, cast({ts} as date)) in (-2, 1, 39, 50)
         or cast({ts} as date) = date '2017-10-31' then 1 else 0 end as integer)"""


def _calendar_sql(ts: str = "ts") -> str:
    weekend = f"cast(case when isodow({ts}) >= 6 then 1 else 0 end as integer)"
    cyc = lambda part, n, fn: f"round({fn}(2 * pi() * ({part}) / {n}), 6)"
    parts = {
        "hour": f"hour({ts})", "day": f"day({ts})", "month": f"month({ts})", "week": f"week({ts})",
        "quarter": f"quarter({ts})", "day_of_week": f"isodow({ts}) - 1", "day_of_year": f"dayofyear({ts})",
        "season": f"(month({ts}) % 12) // 3", "is_weekend": weekend,
        "is_holiday": IS_HOLIDAY_SQL.format(ts=ts), "hour_is_weekend": f"hour({ts}) * {weekend}",
    }
    sql = [f"cast({e} as integer) as {n}" for n, e in parts.items()]
    for name, part, n in (("hour", f"hour({ts})", 24), ("month", f"month({ts})", 12), ("dow", f"isodow({ts}) - 1", 7)):
        sql += [f"{cyc(part, n, fn)} as {name}_{fn}" for fn in ("sin", "cos")]
    return ", ".join(sql)


def _lag_sql(col: str, prefix: str, lags=LAGS) -> str:
    return ", ".join(f"lag({col}, {k}) over w as {prefix}_t_{k}" for k in lags)


def _diff_sql() -> str:
    return ", ".join(f"load_t_{k} - load_t_{k + 1} as load_diff_{k}" for k in (1, 24, 168))


def _rolling_sql(col: str, prefix: str = "", windows=WINDOWS) -> str:
    return ", ".join(
        f"round({fn}({col}) over (partition by series_id order by ts rows between {n} preceding and 1 preceding), {dp})"
        f" as {prefix}rolling_{name}_{n}"
        for n in windows for fn, name, dp in (("avg", "mean", 4), ("stddev_samp", "std", 3))
    )


def _rounded(df, names_digits):
    return df.withColumns({c: F.round(c, d) for c, d in names_digits.items() if c in df.columns})


def round_features(df):
    """Comparable decimals for the derived double columns."""
    digits = {c: 6 for c in df.columns if c.endswith(("_sin", "_cos"))}
    digits |= {c: 4 for c in df.columns if "rolling_mean" in c}
    digits |= {c: 3 for c in df.columns if "rolling_std" in c}
    return _rounded(df, digits)


@query("calendar_features", with_views("load_hourly", HOLIDAY_SQL.format(ts="ts", source="load_hourly") + f"""
    select series_id, ts, y, {_calendar_sql()} from load_hourly join easter on year(ts) = y0"""))
def calendar_features(spark, sf_dir):
    return round_features(features.add_calendar(views.load_hourly(spark, sf_dir)))


@query("holiday_flag", with_views("orders_daily", HOLIDAY_SQL.format(ts="ts", source="orders_daily") + f"""
    select series_id, ts, y, {IS_HOLIDAY_SQL.format(ts='ts')} as is_holiday
    from orders_daily join easter on year(ts) = y0"""))
def holiday_flag(spark, sf_dir):
    from wattline.functions.calendar import is_holiday

    return views.orders_daily(spark, sf_dir).withColumn("is_holiday", is_holiday(F.col("ts")))


@query("lags", with_views("meter_readings", f"""
    l as (select *, {_lag_sql('y', 'load')} from meter_readings window w as (partition by series_id order by ts))
    select *, {_diff_sql()} from l"""))
def lags(spark, sf_dir):
    return features.add_lags(views.meter_readings(spark, sf_dir))


@query("rolling", with_views("meter_readings", f"select *, {_rolling_sql('y')} from meter_readings"))
def rolling(spark, sf_dir):
    return round_features(features.add_rolling(views.meter_readings(spark, sf_dir)))


@query("exog_lags", with_views("load_exog", f"""
    select *, {_lag_sql('y', 'load')}, {_lag_sql('click', 'click')}, {_lag_sql('view', 'view')}
    from load_exog window w as (partition by series_id order by ts)"""))
def exog_lags(spark, sf_dir):
    return features.add_lags(views.load_exog(spark, sf_dir), exog=["click", "view"], diffs=False)


@query("exog_rolling", with_views("load_exog", f"""
    select *, {_rolling_sql('y')}, {_rolling_sql('click', 'click_')}, {_rolling_sql('view', 'view_')} from load_exog"""))
def exog_rolling(spark, sf_dir):
    return round_features(features.add_rolling(views.load_exog(spark, sf_dir), exog=["click", "view"]))


FEATURE_SQL = HOLIDAY_SQL.format(ts="ts", source="load_by_type") + f""",
    l as (select *, {_lag_sql('y', 'load')}, {_rolling_sql('y')}
          from load_by_type window w as (partition by series_id order by ts))
    select l.* , {_diff_sql()}, {_calendar_sql()}
    from l join easter on year(ts) = y0
    where load_t_169 is not null and rolling_std_7 is not null"""


@query("feature_transform", with_views("load_by_type", FEATURE_SQL))
def feature_transform(spark, sf_dir):
    return round_features(features.transform(views.load_by_type(spark, sf_dir)))


@query("chunked_features", with_views("load_by_type", FEATURE_SQL))
def chunked_features(spark, sf_dir):
    """The same features through the chunk-and-halo plan a very long series would take."""
    return round_features(features.transform(views.load_by_type(spark, sf_dir), plan="chunked", chunk_rows=200))


@query("tail_n", with_views("meter_readings", """
    select series_id, ts, y from (
        select *, row_number() over (partition by series_id order by ts desc) as rn from meter_readings)
    where rn <= 24"""))
def tail_n(spark, sf_dir):
    return tail(views.meter_readings(spark, sf_dir), 24)


@query("downsample", with_views("meter_readings", """
    p as (select *, row_number() over (partition by series_id order by ts) - 1 as i,
                 count(*) over (partition by series_id) as n from meter_readings)
    select series_id, ts, y from p where n <= 20 or i % cast(ceil(n / 20.0) as bigint) = 0"""))
def downsample(spark, sf_dir):
    return reports.downsample(views.meter_readings(spark, sf_dir), 20)


@query("plot_context", with_views("load_by_type", """
    r as (select *, row_number() over (partition by series_id order by ts desc) as rn from load_by_type)
    select series_id, ts, y as value, 'actual' as kind from r where rn > 24 and rn <= 24 + 48
    union all
    select series_id, ts, y as value, 'forecast' as kind from r where rn <= 24"""))
def plot_context(spark, sf_dir):
    loads = views.load_by_type(spark, sf_dir)
    newest = tail(loads, 24).withColumnRenamed("y", "forecast")
    history = loads.join(newest.select("series_id", "ts"), ["series_id", "ts"], "left_anti")
    return reports.plot_context(history, newest, horizon="24h")


@query("missing_feature_fill", with_views("load_hourly", """
    select ts, y as load_t_1, 0.0::double as load_t_2, hour(ts)::integer as hour from load_hourly"""))
def missing_feature_fill(spark, sf_dir):
    have = views.load_hourly(spark, sf_dir).withColumn("hour", F.hour("ts")).withColumnRenamed("y", "load_t_1")
    return features.fill_missing_features(have, ["load_t_1", "load_t_2", "hour"], keep=["ts"])


@query("time_split", with_views("meter_readings", """
    p as (select *, row_number() over (partition by series_id order by ts) - 1 as i,
                 count(*) over (partition by series_id) as n from meter_readings),
    c as (select *, n - cast(floor(n * 0.2) as bigint) - cast(floor(n * 0.1) as bigint) as train_n,
                 n - cast(floor(n * 0.2) as bigint) as test_from from p)
    select series_id, ts, y, case when i < train_n then 'train' when i < test_from then 'val' else 'test' end as split
    from c"""))
def time_split(spark, sf_dir):
    return metrics.time_split(views.meter_readings(spark, sf_dir), test_size=0.2, val_size=0.1)


LAG_PREDICTOR = """
    p as (select series_id, ts, y, lag(y, 24) over (partition by series_id order by ts) as pred from {source}),
    v as (select * from p where pred is not null)"""
METRIC_SQL = """round(sqrt(avg((y - pred) * (y - pred))), 3) as rmse, round(avg(abs(y - pred)), 3) as mae,
       round(avg(abs((y - pred) / (abs(y) + 1e-8))) * 100, 3) as mape"""


@query("regression_metrics", with_views("load_by_type", LAG_PREDICTOR.format(source="load_by_type") + f"""
    select series_id, 'lag24' as model, {METRIC_SQL} from v group by series_id"""))
def regression_metrics(spark, sf_dir):
    lagged = features.add_lags(views.load_by_type(spark, sf_dir), lags=[24], diffs=False)
    scored = lagged.withColumn("model", F.lit("lag24")).na.drop(subset=["load_t_24"])
    return metrics.metrics_table(scored, actual="y", predicted="load_t_24", digits=3)


@query("naive_baseline", with_views("meter_readings", """
    p as (select *, row_number() over (partition by series_id order by ts) - 1 as i,
                 count(*) over (partition by series_id) as n from meter_readings),
    c as (select *, i < n - cast(floor(n * 0.2) as bigint) as train from p),
    m as (select series_id, avg(y) as mean_y from c where train group by series_id)
    select c.series_id, round(sqrt(avg((y - mean_y) * (y - mean_y))), 3) as baseline_rmse
    from c join m using (series_id) where not train group by c.series_id"""))
def naive_baseline(spark, sf_dir):
    split = metrics.time_split(views.meter_readings(spark, sf_dir), test_size=0.2)
    out = metrics.naive_baseline(split)
    return out.withColumn("baseline_rmse", F.round("baseline_rmse", 3))


LIMIT_SQL = """
with recursive e as (
    select user_id, ts, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (
    select user_id, ts, event_id, k, true as accepted, cast(null as bigint) as wait, [t] as recent from e where k = 1
    union all
    select user_id, ts, event_id, k, len(kept) < 3, case when len(kept) >= 3 then (21600000000 - (t - kept[1])) // 1000000 end,
           case when len(kept) < 3 then list_append(kept, t) else kept end
    from (select e.user_id, e.ts, e.event_id, e.k, e.t, list_filter(r.recent, lambda a: a >= e.t - 21600000000) as kept
          from r join e on e.user_id = r.user_id and e.k = r.k + 1))
select user_id, ts, event_id, accepted, wait as retry_after_seconds from r"""


@query("rate_limit_audit", LIMIT_SQL)
def rate_limit_audit(spark, sf_dir):
    """At most 3 accepted events per user in any six hours."""
    ev = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return limits.sliding_limit(ev, key="user_id", max_events=3, window_seconds=6 * 3600, tie="event_id")


@query("rate_limit_stream", LIMIT_SQL)
def rate_limit_stream(spark, sf_dir):
    """The same limit on the events as a stream of files: four parts in the order of time, a micro-batch each, decided from the state that the
    parts before have left."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    ev = views.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    placed = reliable(ev.repartitionByRange(4, "ts").withColumn("part", F.spark_partition_id()))
    for k in range(4):  # files of a later part are newer, and the source reads files by age
        placed.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    decided = sliding_limit_stream(source, key="user_id", max_events=3, window_seconds=6 * 3600)
    run = decided.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(decided.schema).parquet(f"{folder}/out")
    return out.select(F.col("user_id").cast("long").alias("user_id"), F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("ts"), "event_id", "accepted", "retry_after_seconds")


FLAGSHIP_CFG = DEFAULTS


@query("flagship", with_views("load_hourly", IQR_CTE.format(source="load_hourly") + f""",
    c as (select h.series_id, ts, least(greatest(y, lower), upper) as y from load_hourly h join b using (series_id)),
    s as (select series_id, avg(y) as m, stddev_samp(y) as sd from c group by series_id),
    cq as (select series_id, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from c group by series_id),
    f as (select *, {_lag_sql('y', 'load', FLAGSHIP_CFG.lags)}, {_rolling_sql('y', windows=FLAGSHIP_CFG.windows)}
          from c window w as (partition by series_id order by ts))
    select f.series_id, f.ts, round(f.y, 4) as y, cast(hour(f.ts) as integer) as hour,
           cast(case when isodow(f.ts) >= 6 then 1 else 0 end as integer) as is_weekend,
           round(load_t_1, 4) as load_t_1, round(load_t_24, 4) as load_t_24, rolling_mean_24,
           cast(case when abs((f.y - m) / (sd + 1e-8)) > 3.0 then 1 else 0 end as integer) as anomaly_zscore,
           cast(case when f.y < q1 - (q3 - q1) * 1.5 or f.y > q3 + (q3 - q1) * 1.5 then 1 else 0 end as integer) as anomaly_iqr
    from f join s using (series_id) join cq using (series_id)
    where load_t_169 is not null"""))
def flagship(spark, sf_dir):
    """Clean, build features and flag outliers in one plan."""
    # statistics, flags and windows all read the clean series, so it is written once
    cleaned = reliable(cleaning.clean(views.load_hourly(spark, sf_dir)))
    plan = choose_plan(cleaned, ["series_id"])
    flagged = anomaly.statistical_flags(cleaned, plan=plan)
    out = features.transform(flagged, keep=["anomaly_zscore", "anomaly_iqr"], cfg=FLAGSHIP_CFG, plan=plan)
    return out.select(
        "series_id", "ts", F.round("y", 4).alias("y"), "hour", "is_weekend", F.round("load_t_1", 4).alias("load_t_1"),
        F.round("load_t_24", 4).alias("load_t_24"), F.round("rolling_mean_24", 4).alias("rolling_mean_24"),
        "anomaly_zscore", "anomaly_iqr",
    )
