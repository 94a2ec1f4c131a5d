"""Anomaly flag, vote, listing and model-based detection queries."""

from pyspark.sql import functions as F

from wattline.operators import anomaly, one_class, reports
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.session import reliable

FLAG_CTES = """
    s as (select series_id, avg(y) as m, stddev_samp(y) as sd, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3
          from {source} group by series_id),
    f as (select r.series_id, ts, y,
                 cast(case when abs((y - m) / (sd + 1e-8)) > {z} then 1 else 0 end as integer) as anomaly_zscore,
                 cast(case when y < q1 - (q3 - q1) * 1.5 or y > q3 + (q3 - q1) * 1.5 then 1 else 0 end as integer) as anomaly_iqr
          from {source} r join s using (series_id)),
    v as (select *, (anomaly_zscore + anomaly_iqr) / 2.0 as anomaly_score,
                 cast(case when anomaly_zscore + anomaly_iqr >= 1 then 1 else 0 end as integer) as is_anomaly from f)"""
SEVERITY_SQL = """case when is_anomaly = 0 then 'none' when anomaly_score >= 0.8 then 'high'
         when anomaly_score >= 0.5 then 'medium' else 'low' end"""


def voted(spark, sf_dir):
    """Two-method vote on raw meter readings."""
    return anomaly.detect(views.meter_readings(spark, sf_dir), methods=("zscore", "iqr"))


def meters(body):
    """Flag CTEs over the meter readings, then ``body`` (more CTEs or a plain select)."""
    if not body.strip().lower().startswith("select"):
        body = "," + body
    return with_views("meter_readings", FLAG_CTES.format(source="meter_readings", z=3.0) + body)


@query("zscore_flags", meters("select series_id, ts, y, anomaly_zscore from f"))
def zscore_flags(spark, sf_dir):
    return anomaly.zscore_flags(views.meter_readings(spark, sf_dir))


@query("iqr_flags", meters("select series_id, ts, y, anomaly_iqr from f"))
def iqr_flags(spark, sf_dir):
    return anomaly.iqr_flags(views.meter_readings(spark, sf_dir))


@query("ensemble_vote", meters("""
    select series_id, ts, y, anomaly_zscore, anomaly_iqr, anomaly_score::double as anomaly_score, is_anomaly from v"""))
def ensemble_vote(spark, sf_dir):
    return voted(spark, sf_dir)


@query("severity", meters(f"""
    select series_id, ts, y as value, is_anomaly = 1 as is_anomaly, anomaly_score::double as anomaly_score, {SEVERITY_SQL} as severity from v"""))
def severity(spark, sf_dir):
    return anomaly.points(voted(spark, sf_dir))


@query("anomaly_heatmap", meters("""
    g as (select unnest(generate_series(0, 167)) as i),
    h as (select dayofweek(ts) as day, hour(ts) as hour, count(*) as c from v where is_anomaly = 1 group by 1, 2),
    n as (select cast(i // 24 as integer) as day, cast(i % 24 as integer) as hour, coalesce(c, 0) as count
          from g left join h on h.day = i // 24 and h.hour = i % 24)
    select day, hour, count, count / greatest(max(count) over (), 1) as pct from n"""))
def anomaly_heatmap(spark, sf_dir):
    return reports.anomaly_heatmap(voted(spark, sf_dir))


@query("method_breakdown", meters("""
    select 'zscore' as method, cast(sum(anomaly_zscore) as bigint) as count from v
    union all select 'iqr', cast(sum(anomaly_iqr) as bigint) from v"""))
def method_breakdown(spark, sf_dir):
    return reports.method_breakdown(voted(spark, sf_dir))


@query("anomaly_rate", meters("""
    select count(*) as total_records, cast(sum(is_anomaly) as bigint) as anomaly_count,
           round(sum(is_anomaly) * 100.0 / greatest(count(*), 1), 2) as anomaly_rate_pct from v"""))
def anomaly_rate(spark, sf_dir):
    return reports.anomaly_rate(voted(spark, sf_dir))


@query("ack_filter", meters("""
    select series_id, ts, y from v where is_anomaly = 1 and hour(ts) >= 12"""))
def ack_filter(spark, sf_dir):
    """Anomalies before noon are acknowledged and hidden."""
    hits = voted(spark, sf_dir).filter("is_anomaly = 1").select("series_id", "ts", "y")
    return reports.hide_acknowledged(hits, hits.filter(F.hour("ts") < 12))


@query("incident_list", meters(f"""
    p as (select series_id, ts, y as value, anomaly_score::double as anomaly_score, {SEVERITY_SQL} as severity,
                 case when hour(ts) < 12 then 'RESOLVED' else 'OPEN' end as status
          from v where is_anomaly = 1)
    select *, 'Time: ' || strftime(ts, '%Y-%m-%d %H:%M') || ' | Value: ' || cast(cast(round(value) as bigint) as varchar)
              || ' | Severity: ' || upper(severity) || ' | Score: ' || cast(cast(round(anomaly_score * 100) as bigint) as varchar)
              || '% | Status: ' || status as line
    from p where severity = 'medium'"""))
def incident_list(spark, sf_dir):
    points = anomaly.points(voted(spark, sf_dir))
    return reports.incident_list(points, points.filter(F.hour("ts") < 12), severity_filter="medium")


@query("anomaly_features", with_views("load_exog", """
    x as (select series_id, ts, y as x0, sin(2 * pi() * hour(ts) / 24) as x1, cos(2 * pi() * hour(ts) / 24) as x2,
                 case when isodow(ts) >= 6 then 1.0 else 0.0 end as x3, coalesce(click, 0.0) as x4, coalesce(view, 0.0) as x5
          from load_exog),
    s as (select series_id, """ + ", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in range(6)) + """
          from x group by series_id)
    select x.series_id, ts, """ + ", ".join(
        f"round((x{i} - m{i}) / case when s{i} = 0 then 1.0 else s{i} end, 5) as x{i}" for i in range(6)) + """
    from x join s using (series_id)"""))
def anomaly_features(spark, sf_dir):
    x = anomaly.standardised(views.load_exog(spark, sf_dir), exog=["click", "view"])
    # + 0.0 turns a rounded -0.0 into 0.0
    return x.select("series_id", "ts", *[F.round(F.col("x")[i], 5).alias(f"x{i}") for i in range(6)])


# Scores strictly over the linear 0.95 quantile of n different scores.
SHARE_SQL = with_views("load_by_type", """
    select series_id, count(*) as n_rows, count(*) - 1 - cast(floor((count(*) - 1) * 0.95) as bigint) as n_flagged from load_by_type group by 1""")


def _share(flags, name):
    return flags.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(name).alias("n_flagged"))


@query("isolation_forest", SHARE_SQL)
def isolation_forest(spark, sf_dir):
    """Every row is scored and the most isolated twentieth of a series is flagged."""
    return _share(anomaly.isolation_forest_flags(views.load_by_type(spark, sf_dir)), "anomaly_isolation_forest")


@query("one_class_svm", SHARE_SQL)
def one_class_svm(spark, sf_dir):
    return _share(anomaly.one_class_svm_flags(views.load_by_type(spark, sf_dir)), "anomaly_one_class_svm")


@query("one_class_optimality", with_views("load_hourly", """
    select 'all' as series_id, count(*) as n_rows, round(0.05 * count(*), 6)::double as weight_sum, count(*) as n_placed, true as nu_splits from load_hourly"""))
def one_class_optimality(spark, sf_dir):
    """Conditions of the dual's optimum, from kernel sums of every row with all support vectors: rows without weight are inside, rows
    of full weight outside, the others on the threshold; the share nu lies between that of the rows outside and that of the vectors."""
    x = reliable(anomaly.standardised(views.load_hourly(spark, sf_dir)))
    vectors = reliable(one_class.fit_one_class(x, 4))
    of = vectors.select("series_id", F.col("ts").alias("sv_ts"), F.col("x").alias("sv"), "weight", "rho")
    apart = F.aggregate(F.zip_with("x", "sv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    own = F.coalesce(F.max(F.when(F.col("ts") == F.col("sv_ts"), F.col("weight"))), F.lit(0.0))
    rows = x.join(of, "series_id").groupBy("series_id", "ts").agg(
        F.sum(F.col("weight") * F.exp(-0.25 * apart)).alias("response"), F.max("rho").alias("rho"), own.alias("weight"))
    above, off = F.col("response") - F.col("rho"), F.lit(one_class.TOLERANCE * 1.01)
    placed = F.when(F.col("weight") == 0, above >= -off).when(F.col("weight") == 1, above <= off).otherwise(F.abs(above) <= off)
    share = F.lit(0.05) * F.count(F.lit(1))
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("weight"), 6).alias("weight_sum"), F.count_if(placed).alias("n_placed"),
        ((F.count_if(above < -off) <= share) & (share <= F.count_if(F.col("weight") > 0))).alias("nu_splits"))


@query("isolation_rows", with_views("load_by_type", "select series_id, ts from load_by_type"))
def isolation_rows(spark, sf_dir):
    """Rows with a flag: each one of the input once."""
    return anomaly.isolation_forest_flags(views.load_by_type(spark, sf_dir)).select("series_id", "ts")


LOF_SQL = with_views("load_hourly", """
    x as (select row_number() over (order by ts) as i, ts, y as x0, sin(2 * pi() * hour(ts) / 24) as x1,
                 cos(2 * pi() * hour(ts) / 24) as x2, case when isodow(ts) >= 6 then 1.0 else 0.0 end as x3 from load_hourly),
    s as (select """ + ", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in range(4)) + """ from x),
    z as (select i, ts, """ + ", ".join(f"(x{i} - m{i}) / s{i} as z{i}" for i in range(4)) + """ from x, s),
    d as (select a.i as p, b.i as q, a.ts as ts,
                 sqrt(pow(a.z0 - b.z0, 2) + pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2) + pow(a.z3 - b.z3, 2)) as dist
          from z a join z b on a.i <> b.i),
    e as (select * from (select *, row_number() over (partition by p order by dist, q) as rn from d) where rn <= 20),
    k as (select p, max(dist) as kdist from e group by p),
    r as (select e.p, e.q, e.ts, greatest(e.dist, k.kdist) as reach from e join k on k.p = e.q),
    lrd as (select p, 1.0 / (avg(reach) + 1e-10) as lrd from r group by p),
    lof as (select r.p, any_value(r.ts) as ts, avg(b.lrd) / any_value(a.lrd) as lof
            from r join lrd a on a.p = r.p join lrd b on b.p = r.q group by r.p)
    select 'all' as series_id, ts, round(lof, 5) as lof from lof""")


@query("lof_scores", LOF_SQL)
def lof_scores(spark, sf_dir):
    out = anomaly.lof_scores(views.load_hourly(spark, sf_dir))
    return out.select("series_id", "ts", F.round("lof", 5).alias("lof"))


@query("anomaly_report", with_views("load_by_type", """
    select series_id, count(*) as n_points, 5 as n_methods, count(*) as n_consistent
    from load_by_type group by 1"""))
def anomaly_report(spark, sf_dir):
    """Five-method vote on the cleaned series: every point with the verdict and severity that its votes give."""
    from wattline.operators.cleaning import clean

    flagged = reliable(anomaly.detect(clean(views.load_by_type(spark, sf_dir))))
    methods = [c for c in flagged.columns if c.startswith("anomaly_") and c != "anomaly_score"]
    votes = flagged.select("series_id", "ts", (sum((F.col(c) for c in methods), F.lit(0)) / 5.0).alias("share"))
    joined = anomaly.report_points(flagged).join(votes, ["series_id", "ts"])
    verdict = (F.col("anomaly_score") == F.round("share", 4)) & (F.col("is_anomaly") == (F.col("share") >= 0.5))
    return joined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.lit(len(methods)).alias("n_methods"), F.count_if(verdict).alias("n_consistent"))
