"""Validation, data quality and cleaning queries."""

from pyspark.sql import functions as F

from wattline.operators import cleaning, quality
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views


@query("quality_report", with_views("load_gappy", """
    tot as (
        select count(*) as total_rows, count(*) - count(distinct (series_id, ts)) as duplicated_rows,
               min(ts) as date_start, max(ts) as date_end,
               count(*) filter (where series_id is null) as m1, count(*) filter (where ts is null) as m2,
               count(*) filter (where y is null) as m3
        from load_gappy)
    select c.column_name, c.missing, round(100.0 * c.missing / total_rows, 2) as missing_pct,
           total_rows, cast(3 as integer) as total_columns, duplicated_rows, date_start, date_end
    from tot, lateral (values ('series_id', m1), ('ts', m2), ('y', m3)) as c(column_name, missing)"""))
def quality_report(spark, sf_dir):
    return quality.report(views.load_gappy(spark, sf_dir))


@query("validate_checks", with_views("load_gappy", """
    s as (select series_id, count(*) as n_rows, avg(case when y is null then 1.0 else 0.0 end) * 100 as p
          from load_gappy group by series_id)
    select series_id, n_rows, round(p, 6) as null_pct, n_rows < 100 as too_small, p = 100 as all_null,
           p > 50 and p < 100 as mostly_null
    from s"""))
def validate_checks(spark, sf_dir):
    return quality.checks(views.load_gappy(spark, sf_dir)).withColumn("null_pct", F.round("null_pct", 6))


@query("dedup_first", with_views("load_dup", """
    select series_id, ts, y, ingest_order from (
        select *, row_number() over (partition by series_id, ts order by ingest_order) as rn from load_dup)
    where rn = 1"""))
def dedup_first(spark, sf_dir):
    return cleaning.dedup_first(views.load_dup(spark, sf_dir), ingest_order="ingest_order")


FILL_CTES = """
    g as (
        select *, epoch_us(ts) as t, row_number() over w as rn,
               lead(epoch_us(ts), 6) over w as t6
        from load_gappy window w as (partition by series_id order by ts)),
    n as (
        select *,
               last_value(case when y is not null then t end ignore nulls) over p as pt,
               last_value(y ignore nulls) over p as pv,
               last_value(case when y is not null then t6 end ignore nulls) over p as p6,
               first_value(case when y is not null then t end ignore nulls) over f as nt,
               first_value(y ignore nulls) over f as nv
        from g
        window p as (partition by series_id order by ts rows between unbounded preceding and current row),
               f as (partition by series_id order by ts rows between current row and unbounded following))"""

FILLED = """
    filled as (
        select series_id, ts,
               coalesce(y,
                        case when pv is not null and nv is not null and nt > pt
                             then pv + (nv - pv) / (nt - pt) * (least(t, p6) - pt) end,
                        pv, nv) as y
        from n)"""


@query("interpolate_limit", with_views("load_gappy", FILL_CTES + "," + FILLED + """
    select series_id, ts, round(y, 4) as y from filled"""))
def interpolate_limit(spark, sf_dir):
    out = cleaning.fill_missing(views.load_gappy(spark, sf_dir), "interpolate")
    return out.withColumn("y", F.round("y", 4))


@query("fill_ff_bf", with_views("load_gappy", FILL_CTES + """
    select series_id, ts, coalesce(y, pv, nv) as y from n"""))
def fill_ff_bf(spark, sf_dir):
    return cleaning.fill_missing(views.load_gappy(spark, sf_dir), "ffill")


@query("fill_bf_ff", with_views("load_gappy", FILL_CTES + """
    select series_id, ts, coalesce(y, nv, pv) as y from n"""))
def fill_bf_ff(spark, sf_dir):
    return cleaning.fill_missing(views.load_gappy(spark, sf_dir), "bfill")


@query("drop_null_target", with_views("load_gappy", "select series_id, ts, y from load_gappy where y is not null"))
def drop_null_target(spark, sf_dir):
    return cleaning.drop_null_target(views.load_gappy(spark, sf_dir))


IQR_CTE = """
    q as (select series_id, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3
          from {source} where y is not null group by series_id),
    b as (select *, q1 - (q3 - q1) * 1.5 as lower, q3 + (q3 - q1) * 1.5 as upper from q)"""


@query("iqr_bounds", with_views("meter_readings", IQR_CTE.format(source="meter_readings") + """
    select series_id, round(q1, 4) as q1, round(q3, 4) as q3, round(lower, 4) as lower, round(upper, 4) as upper from b"""))
def iqr_bounds(spark, sf_dir):
    b = cleaning.iqr_bounds(views.meter_readings(spark, sf_dir))
    return b.select("series_id", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")])


@query("z_bounds", with_views("meter_readings", """
    s as (select series_id, avg(y) as mean, stddev_samp(y) as sd from meter_readings group by series_id)
    select series_id, round(mean, 4) as mean, round(sd, 4) as sd, round(mean - 3.0 * sd, 4) as lower,
           round(mean + 3.0 * sd, 4) as upper from s"""))
def z_bounds(spark, sf_dir):
    b = cleaning.z_bounds(views.meter_readings(spark, sf_dir))
    return b.select("series_id", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "lower", "upper")])


@query("outlier_counts", with_views("meter_readings", IQR_CTE.format(source="meter_readings") + """,
    m as (select series_id, avg(y) as mean, stddev_pop(y) as sd from meter_readings group by series_id)
    select r.series_id, count(*) as n_rows,
           count(*) filter (where y < lower or y > upper) as iqr_outliers,
           count(*) filter (where abs(y - mean) > sd * 3.0) as z_outliers
    from meter_readings r join b using (series_id) join m using (series_id) group by r.series_id"""))
def outlier_counts(spark, sf_dir):
    return cleaning.outlier_counts(views.meter_readings(spark, sf_dir))


@query("winsorise", with_views("meter_readings", IQR_CTE.format(source="meter_readings") + """
    select r.series_id, ts, round(least(greatest(y, lower), upper), 4) as y
    from meter_readings r join b using (series_id)"""))
def winsorise(spark, sf_dir):
    return cleaning.winsorise(views.meter_readings(spark, sf_dir)).withColumn("y", F.round("y", 4))


@query("winsorise_z", with_views("meter_readings", """
    s as (select series_id, avg(y) as mean, stddev_samp(y) as sd from meter_readings group by series_id)
    select r.series_id, ts, round(least(greatest(y, mean - sd * 3.0), mean + sd * 3.0), 4) as y
    from meter_readings r join s using (series_id)"""))
def winsorise_z(spark, sf_dir):
    return cleaning.winsorise(views.meter_readings(spark, sf_dir), "zscore").withColumn("y", F.round("y", 4))


@query("clean", with_views("load_gappy", FILL_CTES + "," + FILLED + "," + IQR_CTE.format(source="filled") + """
    select f.series_id, ts, round(least(greatest(y, lower), upper), 4) as y
    from filled f join b using (series_id)"""))
def clean(spark, sf_dir):
    return cleaning.clean(views.load_gappy(spark, sf_dir)).withColumn("y", F.round("y", 4))


@query("dedup_unordered", with_views("load_dup", """
    n as (select series_id, ts, case when ingest_order % 3 = 0 then null else y end as y, ingest_order from load_dup)
    select series_id, ts, y, ingest_order from (
        select *, row_number() over (partition by series_id, ts order by y nulls last, ingest_order) as rn from n) where rn = 1"""))
def dedup_unordered(spark, sf_dir):
    """Copies without an order: the smallest content, with nulls last."""
    rows = views.load_dup(spark, sf_dir).withColumn("y", F.when(F.col("ingest_order") % 3 != 0, F.col("y")))
    return cleaning.dedup_first(rows)
