"""Whole-run queries on the hourly loads."""

import uuid

from pyspark.sql import functions as F

from wattline.models.selection import ALL_MODELS
from wattline.operators import quality
from wattline.operators.features import feature_names
from wattline.plans import runs, views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.plans.queries_models import FEATURE_SQL, HORIZONS, NO_SEARCH, grid, grid_sql
from wattline.session import checkpoint_folder, reliable

POINTS = sum(HORIZONS.values())
N_FEATURES = len(feature_names())


def _with_short_series(spark, sf_dir):
    """The loads by type, beside one series that is too short, one without values and one too short for features."""
    loads = views.load_by_type(spark, sf_dir)
    first = loads.filter("series_id = 'click'")
    hour = lambda n: F.col("ts") < F.lit("2024-01-01").cast("timestamp_ntz") + F.expr(f"interval {n} hours")
    parts = [loads] + [first.filter(hour(n)).withColumn("series_id", F.concat(F.lit(name), F.substring("series_id", 1, 0)))
                       .withColumn("y", F.when(F.lit(name) != "x_empty", F.col("y"))) for name, n in (("x_short", 40), ("x_empty", 400))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("full_run", with_views("load_by_type", FEATURE_SQL + f"""
    select nr.series_id, {len(ALL_MODELS)}::bigint as n_models, {POINTS}::bigint as forecast_points, true as bands_hold, count(*) as anomaly_rows, 5 as n_methods, {N_FEATURES}::bigint as n_ranked
    from nr group by 1"""))
def full_run(spark, sf_dir):
    """Seven models, three horizons, five anomaly methods, attributions and rules; two of seven series are refused."""
    run = runs.full_run(_with_short_series(spark, sf_dir), raw_anomalies=True, options=NO_SEARCH)
    points = grid(run.tables["forecasts"]).groupBy("series_id").agg(F.count(F.lit(1)).alias("forecast_points"), F.every("bands_hold").alias("bands_hold"))
    flagged = run.tables["anomalies"]
    methods = len([c for c in flagged.columns if c.startswith("anomaly_") and c != "anomaly_score"])
    rows = flagged.groupBy("series_id").agg(F.count(F.lit(1)).alias("anomaly_rows"), F.lit(methods).alias("n_methods"))
    models = run.chosen.metrics.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_models"))
    ranked = run.tables["importance"].groupBy("series_id").agg(F.countDistinct("feature").alias("n_ranked"))
    return models.join(points, "series_id").join(rows, "series_id").join(ranked, "series_id")


@query("rejected_series", with_views("load_by_type", """
    c as (select * from load_by_type where series_id = 'click'),
    p as (select 'x_short' as series_id, y from c where ts < timestamp '2024-01-01' + interval 40 hours
          union all select 'x_empty', null from c where ts < timestamp '2024-01-01' + interval 400 hours)
    select series_id, count(*) as n_rows, avg(case when y is null then 1 else 0 end) * 100.0 as null_pct,
           case when count(y) = 0 then 'target is entirely null' else 'too few rows: ' || count(*) || ' (minimum 100)' end as reason
    from p group by 1 having count(*) < 100 or count(y) = 0"""))
def rejected_series(spark, sf_dir):
    return quality.rejected(_with_short_series(spark, sf_dir))


@query("inference_run", grid_sql("load_by_type"))
def inference_run(spark, sf_dir):
    """A second run that loads the models of the first instead of training."""
    folder = f"{checkpoint_folder(spark)}/selection-{uuid.uuid4().hex}"
    loads = views.load_by_type(spark, sf_dir)
    args = {"explained": False, "models_folder": folder}
    runs.full_run(loads, options=NO_SEARCH, **args)
    return grid(runs.full_run(loads, skip_training=True, **args).tables["forecasts"])


@query("dry_run", with_views("load_by_type", FEATURE_SQL + """
    select series_id, 'loaded' as stage, count(*) as n_rows from nr group by 1
    union all select series_id, 'clean', count(*) from nr group by 1
    union all select series_id, 'features', count(*) from feat group by 1"""))
def dry_run(spark, sf_dir):
    return runs.dry_run(views.load_by_type(spark, sf_dir))


@query("owner_run", with_views("load_by_type", """
    select series_id, count(*) as total_records, round(avg(y), 2) as avg_consumption, max(y) as max_consumption, min(y) as min_consumption,
           min(ts) as date_range_start, max(ts) as date_range_end, '24h,30d,7d' as horizons, true as known_model
    from load_by_type group by 1"""))
def owner_run(spark, sf_dir):
    """Train per owner, publish, and read the dashboard back."""
    folder = f"{checkpoint_folder(spark)}/publish-{uuid.uuid4().hex}"
    stored = reliable(views.load_by_type(spark, sf_dir).withColumnRenamed("y", "value"))
    runs.owner_run(stored, publish_folder=folder, options=NO_SEARCH)
    stats = runs.dashboard(stored, folder)["stats"]
    return stats.select(
        "series_id", "total_records", "avg_consumption", "max_consumption", "min_consumption",
        "date_range_start", "date_range_end", F.array_join("horizons", ",").alias("horizons"), F.col("best_model").isin(*ALL_MODELS).alias("known_model"))
