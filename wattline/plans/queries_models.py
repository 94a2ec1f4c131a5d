"""Model fitting, selection, forecasting and attribution queries."""

import uuid

from pyspark.sql import functions as F

from wattline.config import DEFAULTS, replace
from wattline.models import arima as arima_models
from wattline.models import selection, store
from wattline.models.linear import LinearModel, fit_linear
from wattline.models.series_trees import fit_series_boosted_a, fit_series_boosted_b, fit_series_forest
from wattline.operators import explain, features, forecast, metrics
from wattline.plans import views
from wattline.plans.catalog import query
from wattline.plans.oracle_views import with_views
from wattline.plans.queries_forecast import future
from wattline.session import checkpoint_folder, reliable

# The searches of the forest and of second-order boosting have queries of their own; other queries take their given settings.
NO_SEARCH = {"RandomForest": {"tune": False}, "BoostedA": {"tune": False}}


def split_features(spark, sf_dir, view=views.load_by_type, exog=()):
    """Train and test feature rows, checkpointed because several passes read them."""
    rows = features.transform(view(spark, sf_dir), exog=exog)
    rows = reliable(metrics.time_split(rows))
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


PAIR = ("load_t_1", "load_t_24")
OLS_SQL = """
    l as (select *, lag(y, 1) over w as a, lag(y, 24) over w as b from load_by_type
          window w as (partition by series_id order by ts)),
    v as (select series_id, ts, y, a, b from l where b is not null),
    m as (select series_id, avg(y) as my, avg(a) as ma, avg(b) as mb, var_pop(a) as va, var_pop(b) as vb,
                 covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as ty from v group by series_id),
    c as (select *, (ay * vb - ty * ab) / (va * vb - ab * ab) as ca, (ty * va - ay * ab) / (va * vb - ab * ab) as cb from m),
    d as (select *, my - ca * ma - cb * mb as c0 from c)"""


def pair_model(spark, sf_dir):
    rows = features.add_lags(views.load_by_type(spark, sf_dir), lags=[1, 24], diffs=False).na.drop("any")
    return rows, fit_linear(rows, PAIR)


@query("linear_regression", with_views("load_by_type", OLS_SQL + """
    select v.series_id, ts, round(c0 + ca * a + cb * b, 3) as prediction from v join d using (series_id)"""))
def linear_regression(spark, sf_dir):
    rows, model = pair_model(spark, sf_dir)
    return model.transform(rows).select("series_id", "ts", F.round("prediction", 3).alias("prediction"))


@query("linear_importance", with_views("load_by_type", OLS_SQL + """
    select series_id, 'load_t_1' as feature, round(abs(ca * sqrt(va)), 3) as importance from d
    union all select series_id, 'load_t_24', round(abs(cb * sqrt(vb)), 3) from d"""))
def linear_importance(spark, sf_dir):
    _, model = pair_model(spark, sf_dir)
    return model.importances().withColumn("importance", F.round("importance", 3))


SHAP_SQL = OLS_SQL + """,
    r as (select *, row_number() over (partition by series_id order by ts) as rn from v),
    bg as (select series_id, avg(a) as ba, avg(b) as bb from r group by series_id),
    s as (select r.series_id, ts, 'load_t_1' as feature, ca * (a - ba) as shap from r join bg using (series_id) join d using (series_id)
          union all
          select r.series_id, ts, 'load_t_24', cb * (b - bb) from r join bg using (series_id) join d using (series_id))"""


@query("linear_shap", with_views("load_by_type", SHAP_SQL + "select series_id, ts, feature, round(shap, 3) as shap from s"))
def linear_shap(spark, sf_dir):
    rows, model = pair_model(spark, sf_dir)
    return explain.linear_shap(rows, model).withColumn("shap", F.round("shap", 3))


@query("shap_importance", with_views("load_by_type", SHAP_SQL + """
    select series_id, feature, round(avg(abs(shap)), 3) as mean_abs_shap from s group by 1, 2"""))
def shap_importance(spark, sf_dir):
    rows, model = pair_model(spark, sf_dir)
    out = explain.importance(explain.linear_shap(rows, model))
    return out.withColumn("mean_abs_shap", F.round("mean_abs_shap", 3))


@query("shap_local", with_views("load_by_type", SHAP_SQL + """
    select series_id, ts, round(sum(case when feature = 'load_t_1' then shap end), 3) as load_t_1,
           round(sum(case when feature = 'load_t_24' then shap end), 3) as load_t_24
    from s where ts = timestamp '2024-01-10 12:00:00' group by 1, 2"""))
def shap_local(spark, sf_dir):
    rows, model = pair_model(spark, sf_dir)
    local = explain.local_explanation(explain.linear_shap(rows, model), "2024-01-10 12:00:00")
    return local.select("series_id", "ts", *[F.round(F.col("attributions")[c], 3).alias(c) for c in PAIR])


# Rows with all features, and the newest fifth of them.
FEATURE_SQL = """
    nr as (select series_id, ts, row_number() over (partition by series_id order by ts) - 169 as i,
                  count(*) over (partition by series_id) - 169 as n from load_by_type),
    feat as (select series_id, ts, i, n, i > n - cast(floor(n * 0.2) as bigint) as held from nr where i > 0)"""
HORIZONS = {"24h": 24, "7d": 168, "30d": 720}


def grid_sql(source: str) -> str:
    """Every series, horizon and step, with the bands at their factors."""
    cases = " union all ".join(f"select '{h}' as horizon, {n} as steps" for h, n in HORIZONS.items())
    return with_views(source, future(source, max(HORIZONS.values())) + f""",
    hz as ({cases})
    select series_id, horizon, step, ts, true as bands_hold from fut join hz on step <= steps""")


def grid(points):
    """Places of a forecast, and whether its values are finite and not negative and its bands are 0.9 and 1.1 times the value."""
    f = F.col("forecast")
    near = lambda c, factor: F.abs(F.col(c) - f * factor) <= 1e-9 * (1 + F.abs(f))
    held = (f >= 0) & (f < float("inf")) & near("lower_bound", 0.9) & near("upper_bound", 1.1)
    return points.select("series_id", "horizon", "step", "ts", F.coalesce(held, F.lit(False)).alias("bands_hold"))


def scores_sql(model: str) -> str:
    return with_views("load_by_type", FEATURE_SQL + f"""
    select series_id, '{model}' as model, count(*) as n_test, true as near_train_mean from feat where held group by 1""")


def _tree_scores(spark, sf_dir, fit):
    """Held-out rows of each series, and whether the model's error is near that of the training mean (the loads are noise, so no model is far below it)."""
    train, test = split_features(spark, sf_dir)
    model = fit(train, features.feature_names())
    scored = selection.evaluate(model, test)
    marked = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    n = test.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_test"))
    return scored.join(metrics.naive_baseline(marked), "series_id").join(n, "series_id").select(
        "series_id", "model", "n_test", (F.col("rmse") < F.col("baseline_rmse") * 1.5).alias("near_train_mean"))


@query("random_forest", scores_sql("RandomForest"))
def random_forest(spark, sf_dir):
    return _tree_scores(spark, sf_dir, lambda df, f: fit_series_forest(df, f, tune=False))


@query("random_forest_search", scores_sql("RandomForest"))
def random_forest_search(spark, sf_dir):
    """Ten draws and three folds for every owner."""
    return _tree_scores(spark, sf_dir, fit_series_forest)


@query("boosted_a", scores_sql("BoostedA"))
def boosted_a(spark, sf_dir):
    return _tree_scores(spark, sf_dir, lambda df, f: fit_series_boosted_a(df, f, tune=False))


@query("boosted_a_search", scores_sql("BoostedA"))
def boosted_a_search(spark, sf_dir):
    """Ten draws and three folds for every owner."""
    return _tree_scores(spark, sf_dir, fit_series_boosted_a)


@query("boosted_b", scores_sql("BoostedB"))
def boosted_b(spark, sf_dir):
    """Fifteen trials, one after the other, for every owner."""
    return _tree_scores(spark, sf_dir, fit_series_boosted_b)


def _arima(spark, sf_dir, name, view, exog=()):
    history = view(spark, sf_dir)
    model = arima_models.fit_arima(history, name=name, exog=exog)
    return grid(forecast.forecast_horizons(history, model, exog=exog))


@query("arima", grid_sql("load_by_type"))
def arima(spark, sf_dir):
    return _arima(spark, sf_dir, "ARIMA", views.load_by_type)


@query("sarima", grid_sql("load_by_type"))
def sarima(spark, sf_dir):
    return _arima(spark, sf_dir, "SARIMA", views.load_by_type)


@query("sarimax", grid_sql("load_exog"))
def sarimax(spark, sf_dir):
    return _arima(spark, sf_dir, "SARIMAX", views.load_exog, ["click", "view"])


@query("sarima_tied", with_views("load_by_type", """
    select series_id, 6 as n_coef, 0.0::double as ar_gap, 0.0::double as ma_gap from load_by_type group by 1"""))
def sarima_tied(spark, sf_dir):
    """Cross lags (1 and 24 steps) are the products of their factors."""
    c = F.col("coef")
    gap = lambda v: F.abs(F.round(v, 9)).alias
    table = arima_models.fit_arima(views.load_by_type(spark, sf_dir), name="SARIMA").table
    return table.select("series_id", F.size(c).alias("n_coef"), gap(c[2] + c[0] * c[1])("ar_gap"), gap(c[5] - c[3] * c[4])("ma_gap"))


# Squares of innovations e(t) = w(t) - theta e(t - 1) for 501 values of theta, and the vertex of the parabola through the least three.
MOVING_SQL = with_views("load_by_type", """
    dw as (select series_id, ts, y - lag(y, 24) over (partition by series_id order by ts) as w from load_by_type),
    rows_w as materialized (select series_id, w, row_number() over (partition by series_id order by ts) as t from dw where w is not null),
    scan(series_id, g, t, e, squares) as (
        select series_id, g, 1::bigint, w, w * w from rows_w, range(-250, 251) as grid(g) where t = 1
        union all
        select s.series_id, s.g, r.t, r.w - s.g * 0.002 * s.e, s.squares + pow(r.w - s.g * 0.002 * s.e, 2)
        from scan s join rows_w r on r.series_id = s.series_id and r.t = s.t + 1),
    ends as (select series_id, g, last(squares order by t) as q from scan group by 1, 2),
    near as (select *, lag(q) over w as q0, lead(q) over w as q2 from ends window w as (partition by series_id order by g))
    select series_id, round((min_by(g, q) + 0.5 * min_by((q0 - q2) / (q0 - 2 * q + q2), q)) * 0.002, 3) as theta from near group by 1""").replace("with ", "with recursive ", 1)


@query("arima_moving", MOVING_SQL)
def arima_moving(spark, sf_dir):
    """The moving average of seasonal differences with the least conditional squares."""
    table = arima_models.fit_arima(views.load_by_type(spark, sf_dir), order=(0, 0, 1), seasonal=(0, 1, 0, 24)).table
    return table.select("series_id", F.round(F.col("coef")[0], 3).alias("theta"))


DIFFERENCES_SQL = """
    yw as (select series_id, ts, y, y - lag(y) over w as w from load_by_type window w as (partition by series_id order by ts)),
    ww as (select *, lag(w) over (partition by series_id order by ts) as w1 from yw),
    co as (select series_id, sum(w * w1) filter (where w1 is not null) / sum(w1 * w1) filter (where w1 is not null) as phi,
                  max_by(y, ts) as y, max_by(w, ts) as w from ww group by series_id)"""


@query("arima_walk", with_views("load_by_type", future("load_by_type", 168) + "," + DIFFERENCES_SQL + """
    select fut.series_id, step, fut.ts, round(co.y, 3) as forecast from fut join co using (series_id)"""))
def arima_walk(spark, sf_dir):
    """Order (0, 1, 0): the last value of the history goes on."""
    history = views.load_by_type(spark, sf_dir)
    points = arima_models.fit_arima(history, order=(0, 1, 0)).forecast(history, 168)
    return points.withColumn("forecast", F.round("forecast", 3))


@query("arima_drift", with_views("load_by_type", future("load_by_type", 168) + "," + DIFFERENCES_SQL + """
    select fut.series_id, step, fut.ts, round(greatest(0, co.y + co.w * phi * (1 - pow(phi, step)) / (1 - phi)), 3) as forecast
    from fut join co using (series_id)"""))
def arima_drift(spark, sf_dir):
    """Order (1, 1, 0) has a closed form: a geometric sum of the last difference."""
    history = views.load_by_type(spark, sf_dir)
    points = arima_models.fit_arima(history, order=(1, 1, 0)).forecast(history, 168)
    return points.withColumn("forecast", F.round("forecast", 3))


@query("model_selection", with_views("load_by_type", FEATURE_SQL + f"""
    select series_id, {len(selection.ALL_MODELS)}::bigint as n_models, 1::bigint as n_best, true as best_is_lowest from feat group by 1"""))
def model_selection(spark, sf_dir):
    """All seven models on the same rows: metrics of each per series, and one best."""
    train, test = split_features(spark, sf_dir)
    chosen = selection.run(train, test, features.feature_names(), options=NO_SEARCH)
    best = chosen.best.select("series_id", F.col("model").alias("best_model"), F.col("rmse").alias("best_rmse"))
    return chosen.metrics.join(best, "series_id").groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_models"), F.count_if(F.col("model") == F.col("best_model")).alias("n_best"),
        (F.min("rmse") == F.first("best_rmse")).alias("best_is_lowest"))


def _saved_and_loaded(spark, model):
    folder = f"{checkpoint_folder(spark)}/models-{uuid.uuid4().hex}"
    store.save_model(model, folder, "best")
    return store.load_model(spark, folder, "best")


@query("raw_prediction", with_views("load_by_type", FEATURE_SQL + "select series_id, ts, true as same from feat where held"))
def raw_prediction(spark, sf_dir):
    """Feature rows that lack some columns, predicted by a forest and by its saved and reloaded copy."""
    train, test = split_features(spark, sf_dir)
    model = fit_series_forest(train, features.feature_names(), tune=False)
    sent = test.drop("is_holiday", "rolling_std_7")
    first, second = (selection.predict_raw(m, sent, keep=["ts"]).select("series_id", "ts", F.col("prediction").alias(n))
                     for m, n in ((model, "a"), (_saved_and_loaded(spark, model), "b")))
    return first.join(second, ["series_id", "ts"]).select("series_id", "ts", (F.abs(F.col("a") - F.col("b")) <= 1e-9 * F.abs("a")).alias("same"))


@query("recursive_forecast", grid_sql("load_by_type"))
def recursive_forecast(spark, sf_dir):
    """Linear model per series on all features, all horizons with bands."""
    history = views.load_by_type(spark, sf_dir)
    model = fit_linear(features.transform(history), features.feature_names())
    return grid(forecast.forecast_horizons(history, model))


@query("linear_exact", with_views("load_by_type", """
    f as (select series_id, ts, hour(ts) as h, lag(y) over w as a, avg(y) over (partition by series_id order by ts rows between 24 preceding and 1 preceding) as m,
                 row_number() over w as i from load_by_type window w as (partition by series_id order by ts))
    select series_id, ts, round(3 * a - 2 * m + 500 * h + 7, 2) as prediction from f where i > 169"""))
def linear_exact(spark, sf_dir):
    """A target that is a linear function of three of 37 features, of which some are functions of others: all features are fitted, and every prediction is the target."""
    rows = features.transform(views.load_by_type(spark, sf_dir))
    rows = rows.withColumn("y", 3 * F.col("load_t_1") - 2 * F.col("rolling_mean_24") + 500 * F.col("hour") + 7)
    out = fit_linear(reliable(rows), features.feature_names()).transform(rows)
    return out.select("series_id", "ts", F.round("prediction", 2).alias("prediction"))


@query("recursive_linear", with_views("load_by_type", future("load_by_type", 168) + "," + OLS_SQL + """,
    n as (select series_id, list(y order by ts)[-24:] as h from load_by_type group by 1),
    r as (
      with recursive s as (
        select n.series_id, 0 as step, h, null::double as forecast, c0, ca, cb from n join d using (series_id)
        union all
        select series_id, step + 1, list_append(h[2:], greatest(0, c0 + ca * h[24] + cb * h[1])), greatest(0, c0 + ca * h[24] + cb * h[1]), c0, ca, cb from s where step < 168)
      select series_id, step, forecast from s where step > 0)
    select r.series_id, r.step, fut.ts, round(forecast, 2) as forecast from r join fut on fut.series_id = r.series_id and fut.step = r.step"""))
def recursive_linear(spark, sf_dir):
    """Least squares on two lags, fed with its own forecasts for a week."""
    cfg = replace(DEFAULTS, lags=(1, 24), windows=())
    _, pair = pair_model(spark, sf_dir)
    names = features.feature_names(cfg=cfg)
    wide = F.array(*[F.col("coef")[PAIR.index(c)] if c in PAIR else F.lit(0.0) for c in names])
    model = LinearModel(pair.table.withColumn("coef", wide), names)
    out = forecast.recursive_forecast(views.load_by_type(spark, sf_dir), model, 168, cfg=cfg)
    return out.withColumn("forecast", F.round("forecast", 2))


@query("live_forecast", grid_sql("load_exog"))
def live_forecast(spark, sf_dir):
    """Forest with exogenous columns, saved, loaded and run on the newest data."""
    exog = ["click", "view"]
    history = views.load_exog(spark, sf_dir)
    train = features.transform(history, exog=exog)
    model = fit_series_forest(train, features.feature_names(exog), tune=False)
    return grid(forecast.forecast_horizons(history, _saved_and_loaded(spark, model), exog=exog))


@query("tree_shap", with_views("load_by_type", FEATURE_SQL + f"select series_id, ts, {len(features.feature_names())}::bigint as n_features, 0.0::double as gap from feat where not held"))
def tree_shap(spark, sf_dir):
    """Base value plus attributions less the prediction, of every training row."""
    train, _ = split_features(spark, sf_dir)
    model = fit_series_forest(train, features.feature_names(), tune=False)
    sums = explain.tree_shap(train, model).groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("n_features"), (F.first("base") + F.sum("shap")).alias("total"))
    both = sums.join(model.transform(train).select("series_id", "ts", "prediction"), ["series_id", "ts"])
    return both.select("series_id", "ts", "n_features", (F.abs(F.round(F.col("total") - F.col("prediction"), 4))).alias("gap"))


@query("kernel_shap", with_views("load_by_type", SHAP_SQL + "select series_id, ts, feature, round(shap, 3) + 0.0 as shap from s"))
def kernel_shap(spark, sf_dir):
    """Of a linear model with all rows as background, the kernel method gives the linear attributions."""
    rows, model = pair_model(spark, sf_dir)
    out = explain.kernel_shap(rows, model, background_rows=1000)
    return out.select("series_id", "ts", "feature", (F.round("shap", 3) + 0.0).alias("shap"))
