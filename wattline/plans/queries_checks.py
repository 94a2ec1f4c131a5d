"""Checks, defaults, caps and choices that the other queries pass over."""

from pyspark.sql import functions as F

from wattline.config import DEFAULTS, replace
from wattline.functions.scalar import safe_double
from wattline.models import arima, selection
from wattline.operators import explain, quality, recommend
from wattline.operators.ordering import positions
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.plans.queries_forecast import future
from wattline.plans.queries_models import DIFFERENCES_SQL, SHAP_SQL, pair_model
from wattline.plans.queries_recommend import ALL_CTE, ALL_ROWS, generated


def _message(df, **kw):
    try:
        quality.validate(df, **kw)
    except quality.ValidationError as error:
        return str(error)
    return "valid"


@query("validate_messages", with_views("load_by_type", """
    c as (select * from load_by_type where series_id = 'click' and ts < timestamp '2024-01-03 02:00:00')
    select 'all rows' as case_name, case when count(*) >= 100 then 'valid' end as message from load_by_type
    union all select 'text time, no target', 'validation failed: time key ''ts'' must be a timestamp; missing required columns: [''y'']' from load_by_type having count(*) >= 100
    union all select 'short', 'validation failed: too few rows: ' || count(*) || ' (minimum 100)' from c
    union all select 'short, no values', 'validation failed: too few rows: ' || count(*) || ' (minimum 100); target ''y'' is entirely null' from c"""))
def validate_messages(spark, sf_dir):
    """One error names every check that fails."""
    loads = views.load_by_type(spark, sf_dir)
    short = loads.filter("series_id = 'click'").filter(F.col("ts") < F.lit("2024-01-03 02:00:00").cast("timestamp_ntz"))
    cases = {"all rows": loads, "text time, no target": loads.drop("y").withColumn("ts", F.col("ts").cast("string")),
             "short": short, "short, no values": short.withColumn("y", F.lit(None).cast("double"))}
    return spark.createDataFrame([(name, _message(df)) for name, df in cases.items()], "case_name string, message string")


@query("safe_float", """
    select event_id, case when event_type = 'error' then 0.0 else round(value * 100) end as plain, case when event_type = 'error' then -1.0 else round(value * 100) end as given
    from events""")
def safe_float(spark, sf_dir):
    """Text that is no finite number takes the default."""
    bad = F.array(F.lit("n/a"), F.lit(""), F.lit("NaN"), F.lit("Infinity"), F.lit(None).cast("string"))
    text = F.when(F.col("event_type") == "error", bad[(F.col("event_id") % 5).cast("int")]).otherwise(views.hundredths("value").cast("string"))
    ev = views.table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return ev.select("event_id", safe_double(F.col("t"), 0.0).alias("plain"), safe_double(F.col("t"), -1.0).alias("given"))


CAP = 200


@query("stat_row_caps", with_views("load_by_type", f"""
    r as (select *, row_number() over (partition by series_id order by ts desc) as back from load_by_type),
    s as (select *, y - lag(y) over (partition by series_id order by ts) as w from r where back <= {CAP} + 50 and back > 50),
    t as (select *, lag(w) over (partition by series_id order by ts) as w1 from s),
    co as (select series_id, sum(w * w1) filter (where w1 is not null) / sum(w1 * w1) filter (where w1 is not null) as phi, max_by(y, ts) as y, max_by(w, ts) as w from t group by 1),
    f as (select r.series_id, 51 - back as step, r.y, greatest(0, co.y + co.w * phi * (1 - pow(phi, 51 - back)) / (1 - phi)) as p
          from r join co using (series_id) where back <= 50 and back > 20)
    select series_id, 'ARIMA' as model, round(sqrt(avg((y - p) * (y - p))), 2) as rmse, round(avg(abs(y - p)), 2) as mae from f group by 1"""))
def stat_row_caps(spark, sf_dir):
    """Statistical models on the newest 200 training rows of a series, compared on its first 30 test rows; the order has a closed form."""
    loads = views.load_by_type(spark, sf_dir)
    sizes = loads.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(loads, ["series_id"], ["ts"], pos="i").join(sizes, "series_id")
    train, test = placed.filter("i < n - 50").drop("i", "n"), placed.filter("i >= n - 50").drop("i", "n")
    cfg = replace(DEFAULTS, stat_train_rows=CAP, stat_test_rows=30)
    chosen = selection.run(train, test, [], enabled=["ARIMA"], options={"ARIMA": {"order": (1, 1, 0)}}, cfg=cfg)
    return chosen.metrics.select("series_id", "model", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"))


@query("arima_scan", with_views("load_by_type", future("load_by_type", 168) + "," + DIFFERENCES_SQL + """
    select fut.series_id, step, fut.ts, round(greatest(0, co.y + co.w * phi * (1 - pow(phi, step)) / (1 - phi)), 3) as forecast
    from fut join co using (series_id)"""))
def arima_scan(spark, sf_dir):
    """The forecast of order (1, 1, 0) in chunks of 24 steps, each a task of its own, has the closed form as well."""
    history = views.load_by_type(spark, sf_dir)
    points = arima.fit_arima(history, order=(1, 1, 0)).forecast(history, 168, chunk_steps=24)
    return points.withColumn("forecast", F.round("forecast", 3))


@query("explainer_choice", with_views("load_by_type", SHAP_SQL + """
    select 'LinearExplainer' as kind, series_id, ts, feature, round(shap, 3) + 0.0 as shap from s"""))
def explainer_choice(spark, sf_dir):
    """A statistical best model is explained by a linear model that is fitted to the same rows."""
    rows, linear = pair_model(spark, sf_dir)
    best = arima.fit_arima(views.load_by_type(spark, sf_dir), order=(0, 1, 0))
    kind, out = explain.explain(rows, best, features=linear.features)
    return out.select(F.lit(kind).alias("kind"), "series_id", "ts", "feature", (F.round("shap", 3) + 0.0).alias("shap"))


@query("recommendation_records", with_views("load_by_type", ALL_CTE + "," + ALL_ROWS + """
    select series_id, position, category, priority, title, description, round(estimated_saving_pct, 4) as estimated_saving_pct, 6 as n_fields from final"""))
def recommendation_records(spark, sf_dir):
    """The public fields as JSON text, read back."""
    records = recommend.to_records(generated(spark, sf_dir))
    fields = "category string, priority string, title string, description string, estimated_saving_pct double, action_items array<string>"
    r = F.from_json("record", fields)
    return records.select("series_id", "position", *[r[c].alias(c) for c in ("category", "priority", "title", "description")],
                          F.round(r["estimated_saving_pct"], 4).alias("estimated_saving_pct"), F.size(F.json_object_keys("record")).alias("n_fields"))
