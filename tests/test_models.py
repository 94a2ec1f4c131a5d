import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import frame, raw, sorted_pdf
from wattline.config import DEFAULTS, replace
from wattline.models import selection, store
from wattline.models.arima import difference_weights, expanded_lags, fit_arima
from wattline.models.linear import fit_linear
from wattline.models.trees import boosted_b_candidates, draw, fit_boosted_a, fit_boosted_b, fit_forest, with_folds, with_holdout
from wattline.operators import explain, features, forecast, metrics
from wattline.operators.ordering import head

CFG = replace(DEFAULTS, lags=(1, 2, 3, 24, 25), windows=(7, 24), horizons={"24h": 24, "7d": 168, "30d": 720})
NAMES = features.feature_names(cfg=CFG)
SMALL = {"trees": 10, "depth": 5}


@pytest.fixture(scope="module")
def history(spark):
    return frame(spark, pd.concat([raw(500, 0, exog=False, series="a"), raw(400, 5, exog=False, series="b")], ignore_index=True)).cache()


@pytest.fixture(scope="module")
def rows(history):
    return metrics.time_split(features.transform(history, cfg=CFG)).cache()


@pytest.fixture(scope="module")
def train(rows):
    return rows.filter("split = 'train'").drop("split")


@pytest.fixture(scope="module")
def held(rows):
    return rows.filter("split = 'test'").drop("split")


@pytest.fixture(scope="module")
def forest(train):
    return fit_forest(train, NAMES, params=SMALL, tune=False)


def test_metric_identities(spark):
    def table(pairs):
        df = spark.createDataFrame([("s", "m", float(a), float(b)) for a, b in pairs], "series_id string, model string, y double, prediction double")
        return metrics.metrics_table(df).first()

    assert table([(0, 3), (0, 4)])["rmse"] == pytest.approx(np.sqrt(12.5))
    assert table([(0, 1), (0, 2), (0, 3)])["mae"] == 2
    assert table([(100, 110)])["mape"] == pytest.approx(10)


def test_split_is_chronological(spark):
    df = frame(spark, raw(100, exog=False))
    out = sorted_pdf(metrics.time_split(df))
    assert (out["split"][:80] == "train").all() and (out["split"][80:] == "test").all()


def test_linear_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    parts = []
    for s, (a, b, c) in {"p": (2.0, -3.0, 5.0), "q": (0.5, 4.0, -1.0)}.items():
        x, z = rng.normal(10, 2, 300), rng.normal(-4, 9, 300)
        parts.append(pd.DataFrame({"series_id": s, "ts": pd.date_range("2020-01-01", periods=300, freq="h"), "y": c + a * x + b * z, "x": x, "z": z, "twin": x - z}))
    df = frame(spark, pd.concat(parts, ignore_index=True))
    out = {r["series_id"]: r for r in fit_linear(df, ["x", "z"]).table.collect()}
    np.testing.assert_allclose(out["p"]["coef"], [2, -3], atol=1e-8)
    np.testing.assert_allclose([out["q"]["intercept"], *out["q"]["coef"]], [-1, 0.5, 4], atol=1e-8)
    # an exactly collinear column leaves the predictions alone
    scored = fit_linear(df, ["x", "z", "twin"]).transform(df)
    assert scored.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-6


def test_linear_on_features_beats_the_mean(train, held, rows):
    model = fit_linear(train, NAMES)
    got = {r["series_id"]: r["rmse"] for r in selection.evaluate(model, held).collect()}
    bar = {r["series_id"]: r["baseline_rmse"] for r in metrics.naive_baseline(rows).collect()}
    assert all(got[s] < bar[s] for s in bar)


def test_forest_importances_sum_to_one(forest):
    assert sum(v for _, v in forest.importances()) == pytest.approx(1.0)


def test_boosted_beats_the_mean(train, held, rows):
    model = fit_boosted_a(train, NAMES, params={"trees": 15, "depth": 3, "rate": 0.3}, tune=False)
    got = {r["series_id"]: r["rmse"] for r in selection.evaluate(model, held).collect()}
    bar = {r["series_id"]: r["baseline_rmse"] for r in metrics.naive_baseline(rows).collect()}
    assert all(got[s] < bar[s] for s in bar)


def test_searches(train):
    some = train.filter("series_id = 'a'")
    grid = {"trees": [3, 5], "depth": [2, 3], "min_split": [2], "min_leaf": [1]}
    assert fit_forest(some, NAMES[:6], grid=grid, draws=2).name == "RandomForest"
    grid = {"trees": [2, 3], "rate": [0.1], "depth": [2], "rows": [1.0], "columns": [1.0]}
    assert fit_boosted_a(some, NAMES[:6], grid=grid, draws=2).name == "BoostedA"
    trials = [{"trees": 2, "rate": 0.1, "depth": 2, "min_leaf": 5, "rows": 1.0, "columns": 1.0}]
    assert fit_boosted_b(some, NAMES[:6], candidates=trials).name == "BoostedB"
    assert len(draw(grid, 10, 1)) == 2 and len(boosted_b_candidates(15, 42)) == 15


def test_holdout_and_folds(spark):
    df = frame(spark, raw(200, exog=False))
    assert with_holdout(df).filter("_holdout").count() == 20
    assert with_holdout(frame(spark, raw(15, exog=False))).filter("_holdout").count() == 0
    assert [r["count"] for r in with_folds(df).groupBy("_fold").count().orderBy("_fold").collect()] == [67, 67, 66]


def test_node_arrays_predict_like_the_model(forest, held):
    pdf = forest.transform(held).toPandas()
    np.testing.assert_allclose(forest.nodes().predict(pdf[NAMES].to_numpy(dtype=float)), pdf["prediction"], rtol=1e-9)


def test_tree_shap_adds_up(forest, held):
    shap = explain.tree_shap(held, forest, max_rows=30)
    total = shap.groupBy("series_id", "ts").agg((F.first("base") + F.sum("shap")).alias("sum"))
    diff = total.join(forest.transform(held), ["series_id", "ts"]).agg(F.max(F.abs(F.col("sum") - F.col("prediction"))), F.count("*")).first()
    assert diff[0] < 1e-6 and diff[1] == 60


def test_tree_shap_matches_enumeration():
    """All feature subsets of one small tree, weighted by the definition."""
    from itertools import combinations
    from math import factorial

    from wattline.models.trees import TreeNodes
    from wattline.operators.explain import PathGames

    nodes = TreeNodes(
        np.array([0]), np.array([1.0]), np.array([0, 1, -1, -1, 0, -1, -1]), np.array([0.5, 0.3, 0, 0, 0.8, 0, 0]),
        np.array([1, 2, 2, 3, 5, 5, 6]), np.array([4, 3, 2, 3, 6, 5, 6]), np.array([0, 0, 1.0, 5.0, 0, -2.0, 7.0]),
        np.array([10, 6, 2, 4, 4, 1, 3.0]),
    )

    def value(x, known, at=0):
        f = nodes.feature[at]
        if f < 0:
            return nodes.value[at]
        left, right = nodes.left[at], nodes.right[at]
        if f in known:
            return value(x, known, left if x[f] <= nodes.threshold[at] else right)
        return sum(nodes.count[c] * value(x, known, c) for c in (left, right)) / nodes.count[at]

    games = PathGames(nodes, 3)
    for x in np.random.default_rng(0).uniform(size=(20, 3)):
        want = np.zeros(3)
        for i in range(3):
            for size in range(3):
                for s in combinations([j for j in range(3) if j != i], size):
                    w = factorial(size) * factorial(2 - size) / factorial(3)
                    want[i] += w * (value(x, {*s, i}) - value(x, set(s)))
        np.testing.assert_allclose(games.values(x[None])[0], want, atol=1e-12)


def test_kernel_shap_on_a_linear_model(train):
    names = ["load_t_1", "load_t_24", "hour_sin"]
    model = fit_linear(train, names)
    back = head(train, 20)
    one = explain.kernel_shap(train, model, background=back, max_rows=5, budget=30)
    two = explain.linear_shap(train, model, background=back, max_rows=5)
    both = one.join(two.withColumnRenamed("shap", "other"), ["series_id", "ts", "feature"])
    row = both.agg(F.max(F.abs(F.col("shap") - F.col("other"))), F.count("*")).first()
    assert row[0] < 1e-5 and row[1] == 30


def test_explainer_choice(train, forest):
    linear = fit_linear(train, ["load_t_1"])
    assert explain.explainer_kind(None) == explain.explainer_kind(linear) == "LinearExplainer"
    assert explain.explainer_kind(forest) == "TreeExplainer"
    kind, shap = explain.explain(train, None, features=["load_t_1", "hour"], max_rows=5)
    table = explain.importance(shap).collect()
    assert kind == "LinearExplainer" and len(table) == 4


def test_horizons(history, forest):
    out = sorted_pdf(forecast.forecast_horizons(history, forest, cfg=CFG), by=("series_id", "horizon", "step"))
    sizes = out.groupby(["series_id", "horizon"]).size().unstack()
    assert (sizes["24h"] == 24).all() and (sizes["7d"] == 168).all() and (sizes["30d"] == 720).all()
    last = history.groupBy("series_id").agg(F.max("ts").alias("t")).toPandas().set_index("series_id")["t"]
    for (s, _), g in out.groupby(["series_id", "horizon"]):
        assert g["ts"].iloc[0] == last[s] + pd.Timedelta(hours=1)
        assert (g["ts"].diff().dropna() == pd.Timedelta(hours=1)).all()
    np.testing.assert_allclose(out["lower_bound"], out["forecast"] * 0.9)
    np.testing.assert_allclose(out["upper_bound"], out["forecast"] * 1.1)
    assert (out["forecast"] >= 0).all()


def test_recursion_uses_the_features_spark_builds(spark):
    """The first step predicts from the row Spark would build for the next hour; one step late
    it uses the row before."""
    pdf = raw(400, 3)
    exog = ["solar"]
    df = frame(spark, pdf.drop(columns="wind"))
    known, coming = df.filter(F.col("ts") < pdf["ts"].iloc[-1]), pdf["ts"].iloc[-1]
    names = features.feature_names(exog, CFG)
    model = fit_linear(features.transform(known, exog=exog, cfg=CFG), names)
    future = forecast.future_exog(known, 1, exog).select("series_id", "ts", F.lit(1.0).alias("y"), "solar")
    built = features.transform(known.unionByName(future), exog=exog, cfg=CFG)
    want = {r["ts"]: r["prediction"] for r in model.transform(built).orderBy(F.col("ts").desc()).limit(2).collect()}
    times = sorted(want)
    assert times[-1] == coming.to_pydatetime()
    for late, at in ((False, times[-1]), (True, times[-2])):
        got = forecast.recursive_forecast(known, model, 1, exog=exog, cfg=CFG, one_step_late=late).first()
        assert got["ts"] == coming.to_pydatetime() and got["forecast"] == pytest.approx(want[at], rel=1e-9)


def test_short_history_repeats_the_last_value(spark, forest):
    df = frame(spark, raw(10, exog=False))
    out = forecast.recursive_forecast(df, forest, 3, cfg=CFG)
    last = df.orderBy(F.col("ts").desc()).first()["y"]
    assert [r["forecast"] for r in out.collect()] == [last] * 3


def test_difference_polynomials():
    assert difference_weights(1, 1, 24) == {0: 1.0, 1: -1.0, 24: -1.0, 25: 1.0}
    assert expanded_lags(1, 1, 24) == [1, 24, 25]


def test_arma_recovery(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, 4000)
    w = np.zeros(4000)
    for t in range(1, 4000):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.4 * e[t - 1]
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=4000, freq="h"), "y": 1000 + np.cumsum(w)})
    coef = fit_arima(frame(spark, pdf), order=(1, 1, 1)).table.first()["coef"]
    np.testing.assert_allclose(coef, [0.6, 0.4], atol=0.06)


def test_sarimax_follows_the_season(spark):
    pdf = raw(1000, 2)
    df = frame(spark, pdf.iloc[:952])
    for name in ("SARIMA", "SARIMAX"):
        model = fit_arima(df, name=name, exog=["solar"])
        got = sorted_pdf(model.forecast(df, 48), by=("series_id", "step"))["forecast"].to_numpy()
        truth = pdf["y"].to_numpy()[952:]
        assert np.sqrt(np.mean((got - truth) ** 2)) < 0.5 * truth.std(), name


def test_selection_skips_failures_and_saves(spark, train, held, history, tmp_path):
    chosen = selection.run(
        train, held, NAMES, enabled=("LinearRegression", "RandomForest", "ARIMA"), cfg=CFG,
        options={"RandomForest": {"params": SMALL, "tune": False, "nonsense": 1}},
    )
    assert set(chosen.models) == {"LinearRegression", "ARIMA"}
    best = {r["series_id"]: r["rmse"] for r in chosen.best.collect()}
    for r in chosen.metrics.collect():
        assert best[r["series_id"]] <= r["rmse"]
    for name, model in chosen.models.items():
        assert not store.model_exists(spark, str(tmp_path), name)
        store.save_model(model, str(tmp_path), name)
        again = store.load_model(spark, str(tmp_path), name)
        a, b = [selection.evaluate(m, held).orderBy("series_id").toPandas() for m in (model, again)]
        pd.testing.assert_frame_equal(a, b)
    with pytest.raises(ValueError):
        store.load_model(spark, str(tmp_path), "absent")
    with pytest.raises(ValueError):
        selection.predict_raw(chosen.models["ARIMA"], held)
    with pytest.raises(RuntimeError):
        selection.run(train, held, NAMES, enabled=("RandomForest",), options={"RandomForest": {"nonsense": 1}}, cfg=CFG)


def test_arima_goes_on_from_the_given_history(spark):
    """A line that rises by 10 an hour; the model has seen its first four fifths only."""
    line = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2024-01-01", periods=600, freq="h"), "y": np.arange(600) * 10.0})
    df = frame(spark, line)
    model = fit_arima(df.filter("y < 4800"), name="ARIMA")
    first = model.forecast(df, 24).orderBy("step").collect()
    assert first[0]["forecast"] == pytest.approx(6000, rel=0.01) and str(first[0]["ts"]).startswith("2024-01-26 00")
    future = df.filter("y >= 4800").select("series_id", "ts", F.lit(1).alias("step")).limit(1)
    assert model.forecast(None, 0, future=future).first()["forecast"] == pytest.approx(4800, rel=0.01)


def test_arima_in_chunks_is_the_same(spark):
    df = frame(spark, raw(400, 3, exog=False))
    plain, cut = fit_arima(df, name="SARIMA", plan="plain"), fit_arima(df, name="SARIMA", plan="chunked", chunk_rows=120)
    a, b = (m.table.first()["coef"] for m in (plain, cut))
    assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_kernel_shap_of_one_feature(train):
    model = fit_linear(train, ["load_t_1"])
    rows = explain.kernel_shap(train, model, max_rows=3).collect()
    linear = {(r["series_id"], r["ts"]): r["prediction"] for r in model.transform(train).collect()}
    assert rows and all(r["base"] + r["shap"] == pytest.approx(linear[r["series_id"], r["ts"]]) for r in rows)
