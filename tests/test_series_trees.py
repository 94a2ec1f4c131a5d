"""Ensembles of single series against plain versions, over all tasks and in one."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import frame, raw
from wattline.config import DEFAULTS, replace
from wattline.models import proposals, selection, series_trees, store
from wattline.models.histograms import LocalRows, Rule, best_splits, bin_codes, bin_edges, growing, histograms, poisson, sparse_splits, target_scale, uniform
from wattline.models.linear import fit_linear
from wattline.operators import explain, features, forecast, metrics

CFG = replace(DEFAULTS, lags=(1, 2, 3, 24, 25), windows=(7, 24), horizons={"24h": 24, "7d": 168, "30d": 720})
NAMES = features.feature_names(cfg=CFG)
FOREST = {"trees": 8, "depth": 4}
BOOST_A = {"trees": 12, "depth": 3, "rate": 0.3}
BOOST_B = {"trees": 12, "leaves": 6, "depth": 4, "min_leaf": 5, "rate": 0.3}
FITS = {"RandomForest": (series_trees.fit_series_forest, FOREST), "BoostedA": (series_trees.fit_series_boosted_a, BOOST_A),
        "BoostedB": (series_trees.fit_series_boosted_b, BOOST_B)}


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
def models(train):
    return {name: fit(train, NAMES, params=params, tune=False) for name, (fit, params) in FITS.items()}


def table_of(model):
    return {r["series_id"]: tuple(r) for r in model.table.orderBy("series_id").collect()}


def test_no_series_shapes_another(spark, train, held, models):
    """Predictions of a series stay when all other rows change or go."""
    own = held.filter("series_id = 'a'")
    changed = train.withColumn("y", F.when(F.col("series_id") == "b", F.col("y") * -3 + 7).otherwise(F.col("y")))
    for name, (fit, params) in FITS.items():
        want = {r.ts: r.prediction for r in models[name].transform(own).collect()}
        assert len(want) > 50
        for other in (changed, train.filter("series_id = 'a'")):
            assert {r.ts: r.prediction for r in fit(other, NAMES, params=params, tune=False).transform(own).collect()} == want


@pytest.mark.parametrize("name", list(FITS))
def test_long_series_give_the_same_trees(train, models, name, monkeypatch):
    """A series over the limit is grown by jobs over all tasks: the same model, number by number."""
    fit, params = FITS[name]
    monkeypatch.setattr(series_trees, "WRITE_ROUNDS", 5)
    own = train.filter("series_id = 'b'").repartition(3)
    small = {"trees": 3 if name == "RandomForest" else 6}
    one = fit(own, NAMES, params={**params, **small}, tune=False)
    many = fit(own, NAMES, params={**params, **small}, tune=False, group_rows=100)
    assert table_of(one) == table_of(many)


def test_best_models_beat_the_mean(held, rows, models):
    bar = {r["series_id"]: r["baseline_rmse"] for r in metrics.naive_baseline(rows).collect()}
    for model in models.values():
        got = {r["series_id"]: r["rmse"] for r in selection.evaluate(model, held).collect()}
        assert all(got[s] < bar[s] for s in bar)


def test_importances_saving_and_attributions(spark, tmp_path, held, models):
    for name, model in models.items():
        shares = {r[0]: r[1] for r in model.importances().groupBy("series_id").agg(F.sum("importance")).collect()}
        assert shares == {"a": pytest.approx(1.0), "b": pytest.approx(1.0)}
        store.save_model(model, str(tmp_path), name)
        again = store.load_model(spark, str(tmp_path), name)
        assert again.name == name and table_of(again) == table_of(model)
        shap = explain.tree_shap(held, model, max_rows=20).groupBy("series_id", "ts").agg((F.first("base") + F.sum("shap")).alias("sum"))
        diff = shap.join(model.transform(held), ["series_id", "ts"]).agg(F.max(F.abs(F.col("sum") - F.col("prediction"))), F.count("*")).first()
        assert diff[0] < 1e-6 and diff[1] == 40
    assert explain.explain(held.limit(5), models["BoostedB"], budget=100, background_rows=5)[0] == "KernelExplainer"


def test_searches(train):
    """Settings are chosen for each series by itself."""
    some = train.select("series_id", "ts", "y", *NAMES[:6])
    grid = {"trees": [3, 5], "depth": [2, 3], "min_split": [2], "min_leaf": [1]}
    model = series_trees.fit_series_forest(some, NAMES[:6], grid=grid, draws=3)
    alone = series_trees.fit_series_forest(some.filter("series_id = 'b'"), NAMES[:6], grid=grid, draws=3)
    assert table_of(model)["b"] == table_of(alone)["b"]
    assert series_trees.fit_series_boosted_a(some, NAMES[:6], grid={"trees": [4], "rate": [0.1, 0.3], "depth": [2], "rows": [0.8], "columns": [0.8]}, draws=2).table.count() == 2


def best_cut(x, y, w, least, l2, split_rows, scale):
    """All cuts of all columns at their edges."""
    g, h, best = float((y * w).sum()) / scale, float(w.sum()), None
    if h < split_rows:
        return None
    for f in range(x.shape[1]):
        for b in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= b
            gl, hl = float((y * w)[left].sum()) / scale, float(w[left].sum())
            if min(hl, h - hl) < least or min(hl, h - hl) <= 0:
                continue
            gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
            if gain > (best[0] if best else 0.0):
                best = (gain, f, b)
    return best


@pytest.mark.parametrize("rule", [Rule(depth=3, least_rows=2, split_rows=5), Rule(depth=3, l2=1.0), Rule(depth=4, leaves=6, least_rows=3)])
def test_trees_equal_plain_ones(rule):
    rng = np.random.default_rng(3)
    for trial in range(6):
        x = rng.integers(0, 12, (80, 4)).astype(float)
        y = x[:, 0] * 3 - (x[:, 1] > 5) * x[:, 2] + rng.normal(0, 1, 80).round(2)
        edges = [bin_edges(x[:, k], 64) for k in range(4)]
        codes, scale = bin_codes(x, edges), target_scale(y)
        goal, w = np.rint(y * scale), poisson(uniform(np.arange(80), 1, trial))
        tree = LocalRows(codes, 64, scale).tree(goal * w, w, rule)
        # plain: rows of every node as a mask, nodes in the order of growth
        nodes, splits, queue = [w > 0], {}, []

        def cut(k, depth):
            m = nodes[k]
            return None if depth >= rule.depth else best_cut(codes[m], goal[m], w[m], rule.least_rows, rule.l2, rule.split_rows, scale)

        def divide(k, found):
            splits[k] = (found[1], int(found[2]))
            left = codes[:, found[1]] <= found[2]
            nodes.extend([nodes[k] & left, nodes[k] & ~left])
            return len(nodes) - 2, len(nodes) - 1

        if rule.leaves is None:
            level = [0]
            for depth in range(rule.depth):
                found = [(k, cut(k, depth)) for k in level]
                level = [c for k, f in found if f for c in divide(k, f)]
        else:
            depth, leaves = {0: 0}, 1
            queue = [(0, cut(0, 0))]
            while leaves < rule.leaves and (ready := [q for q in queue if q[1]]):
                k, f = max(ready, key=lambda q: (q[1][0], -q[0]))
                queue = [q for q in queue if q[0] != k]
                for c in divide(k, f):
                    depth[c] = depth[k] + 1
                    queue.append((c, cut(c, depth[c])))
                leaves += 1
        assert {k: (f, b) for k, (f, b) in enumerate(zip(tree.feature, tree.bin)) if f >= 0} == splits and len(tree.g) == len(nodes)
        assert [int(h) for h in tree.h] == [int(w[m].sum()) for m in nodes]
        at = tree.walk(codes)
        assert all(nodes[k][i] for i, k in enumerate(at.tolist()) if w[i] > 0)


def test_sparse_histograms_give_the_same_splits():
    rng = np.random.default_rng(5)
    for _ in range(30):
        codes = rng.integers(0, rng.integers(2, 30), (60, 5)).astype(np.uint8)
        slot, g, h = rng.integers(0, 9, 60), rng.integers(-50, 50, 60).astype(float), rng.integers(1, 4, 60).astype(float)
        rule, columns = Rule(depth=3, l2=float(rng.integers(0, 2)), least_rows=2, split_rows=4), rng.random(5) < 0.7
        want = best_splits(histograms(codes, slot, g, h, 9, 32), 4.0, rule, columns)
        assert sparse_splits(codes, slot, g, h, 9, 32, 4.0, rule, columns) == want and any(want)


def test_boosting_ends_without_progress():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.sign(x[:, 0]) + 0.01 * rng.normal(size=300)
    last = series_trees.holdout(300)
    p = {**series_trees.BOOSTED_A_DEFAULTS, "rate": 0.5, "trees": 200}
    made = series_trees.train_local("BoostedA", p, x, y, np.arange(300), last, 42)
    assert 0 < len(made.trees) < 100
    errors = [np.mean((made.of_codes(bin_codes(x[last], made.edges), made.trees[:k]) - y[last]) ** 2) for k in range(1, len(made.trees) + 1)]
    assert int(np.argmin(errors)) + 1 == len(made.trees)
    assert last.sum() == 30 and series_trees.holdout(19) is None and series_trees.holdout(20).sum() == 5 and series_trees.holdout(5000).sum() == 100
    flat = series_trees.train_local("BoostedB", series_trees.BOOSTED_B_DEFAULTS, x, np.ones(300), np.arange(300), last, 42)
    assert np.allclose(flat.of_codes(bin_codes(x, flat.edges)), 1.0)


def test_second_order_stump():
    """One round of depth one by hand: gain and leaf values with L2."""
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    y = np.array([0.0, 0.0, 8.0, 8.0])
    p = {**series_trees.BOOSTED_A_DEFAULTS, "trees": 1, "depth": 1, "rate": 1.0, "rows": 1.0, "columns": 1.0}
    made = series_trees.train_local("BoostedA", p, x, y, np.arange(4), None, 42)
    assert made.base == 4.0 and made.trees[0].gain[0] == pytest.approx(2 * 64 / 3)
    np.testing.assert_allclose(made.of_codes(bin_codes(x, made.edges)), [4 - 8 / 3] * 2 + [4 + 8 / 3] * 2)


def test_samples():
    u = uniform(np.arange(200_000), 42, 7)
    assert abs(u.mean() - 0.5) < 0.005 and (u == uniform(np.arange(200_000), 42, 7)).all() and (u != uniform(np.arange(200_000), 42, 8)).mean() > 0.99
    w = poisson(u)
    assert abs(w.mean() - 1) < 0.01 and abs((w == 0).mean() - math.exp(-1)) < 0.01


def plain_proposal(space, past, seed):
    """The proposal from its definition: one curve per trial and one over the range, cut at the bounds."""
    rng = np.random.default_rng([seed, len(past)])
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))

    def curves(points, low, high):
        centres = [*points, (low + high) / 2]
        widths = []
        for k, c in enumerate(centres):
            order = sorted(range(len(centres)), key=lambda j: (centres[j], j))
            at = order.index(k)
            below = centres[order[at - 1]] if at else low
            above = centres[order[at + 1]] if at + 1 < len(order) else high
            widths.append(min(high - low, max((high - low) / min(100, 1 + len(centres)), c - below, above - c)))
        widths[-1] = high - low
        return list(zip(centres, widths))

    def density(x, parts, low, high):
        return math.log(sum(math.exp(-0.5 * ((x - c) / s) ** 2) / (s * math.sqrt(2 * math.pi) * (phi((high - c) / s) - phi((low - c) / s))) for c, s in parts) / len(parts) + 1e-300)

    ranked = sorted(range(len(past)), key=lambda k: (past[k][1], k))
    good = sorted(ranked[:math.ceil(0.1 * len(past))])
    out = {}
    for name, r in space.items():
        low, high = r.inner()
        own = curves([r.place(past[k][0][name]) for k in good], low, high)
        rest = curves([r.place(past[k][0][name]) for k in range(len(past)) if k not in good], low, high)
        xs = []
        while len(xs) < 24:
            c, s = own[rng.integers(len(own))]
            x = rng.normal(c, s)
            while not low <= x <= high:
                x = rng.normal(c, s)
            xs.append(x)
        out[name] = r.value(max(xs, key=lambda x: density(x, own, low, high) - density(x, rest, low, high)))
    return out


def test_proposals_equal_the_plain_version():
    space = series_trees.BOOSTED_B_RANGES
    error = lambda p: (math.log(p["rate"]) + 3) ** 2 + abs(p["leaves"] - 50) / 100 + p["trees"] / 1000
    past = []
    for k in range(25):
        own = proposals.propose(space, past, 42)
        assert own == proposals.propose(space, past, 42) and set(own) == set(space)
        for name, r in space.items():
            assert r.low <= own[name] <= r.high and (not r.whole or (own[name] - r.low) % r.step == 0)
        if k >= proposals.RANDOM_TRIALS:
            assert own == plain_proposal(space, past, 42)
        past.append((own, error(own)))
    first, later = [e for _, e in past[:10]], [e for _, e in past[10:]]
    assert np.mean(later) < np.mean(first)


def plain_recursion(y, fixed, names, given, horizon, score, late):
    """One series and one step at a time, every feature from its definition."""
    y = list(y)
    start = len(y)
    for i in range(start, start + horizon):
        at = i - 1 if late else i
        x = dict(zip(given, fixed[at]))
        for k in CFG.lags:
            x[f"load_t_{k}"] = y[at - k] if at >= k else np.nan
        for k in features.DIFF_LAGS:
            x[f"load_diff_{k}"] = y[at - k] - y[at - k - 1] if at >= k + 1 else np.nan
        for n in CFG.windows:
            part = np.array(y[max(0, at - n):at])
            x[f"rolling_mean_{n}"] = part.mean() if len(part) else np.nan
            x[f"rolling_std_{n}"] = part.std(ddof=1) if len(part) > 1 else np.nan
        row = np.array([x[c] for c in names], float)
        known = [v for v in y if np.isfinite(v)]
        y.append(max(0.0, score(row)) if np.isfinite(row).all() else (known[-1] if known else 0.0))
    return y[start:]


@pytest.mark.parametrize("late", [False, True])
def test_panels_equal_the_loop(spark, history, train, models, late, monkeypatch):
    """Series of unequal length, one too short for the lags, in one panel and in several."""
    short = history.filter("series_id = 'a'").orderBy("ts").limit(10).withColumn("series_id", F.concat(F.lit("short"), F.substring("series_id", 1, 0)))
    known = history.unionByName(short)
    linear = fit_linear(train, NAMES)
    extra = linear.table.filter("series_id = 'a'").withColumn("series_id", F.concat(F.lit("short"), F.substring("series_id", 1, 0)))
    linear.table = linear.table.unionByName(extra)
    forest = models["RandomForest"]
    for model in (linear, forest):
        own = known if model is linear else history
        for size in (64, 1):
            monkeypatch.setattr(forecast, "PANEL_SERIES", size)
            got = forecast.recursive_forecast(own, model, 30, cfg=CFG, one_step_late=late).toPandas()
            for name, pdf in own.toPandas().groupby("series_id"):
                pdf = pdf.sort_values("ts").tail(56 if len(pdf) > 56 else len(pdf))
                times = pd.date_range(pdf["ts"].iloc[0], periods=len(pdf) + 30, freq="h")
                calendar = spark.createDataFrame(pd.DataFrame({"series_id": name, "ts": times, "y": 0.0})).withColumns(forecast.calendar_columns(F.col("ts")))
                given = [c for c in NAMES if c in forecast.CALENDAR_COLUMNS]
                fixed = calendar.orderBy("ts").toPandas()[given].to_numpy(float)
                params = model.parameters().filter(F.col("series_id") == name).toPandas().iloc[0]
                score = lambda x: float(np.ravel(model.matrix_scorer()(x[None, :], params))[0])  # noqa: B023, E731
                want = plain_recursion(pdf["y"], fixed, NAMES, given, 30, score, late)
                mine = got[got["series_id"] == name].sort_values("step")["forecast"].to_numpy()
                np.testing.assert_allclose(mine, want, rtol=1e-7)


def test_growth_in_steps_gives_the_same_tree():
    """Children asked for before their leaf is split change nothing, and a tree takes few steps."""
    rng = np.random.default_rng(4)
    for trial in range(20):
        codes = rng.integers(0, 20, (200, 4)).astype(np.uint8)
        g, h = rng.integers(-60, 60, 200).astype(float), np.ones(200)
        rule = Rule(depth=int(rng.integers(0, 8)) or None, leaves=[None, 1, 2, 9, 25][trial % 5], least_rows=3)
        steps, count = growing((float(g.sum()), 200.0), rule), 0
        try:
            tree, nodes = next(steps)
            while True:
                count += 1
                at = tree.walk(codes)
                found = [best_splits(histograms(codes[at == n], np.zeros((at == n).sum(), int), g[at == n], h[at == n], 1, 64), 1.0, rule)[0] for n in nodes]
                tree, nodes = steps.send(found)
        except StopIteration as end:
            assert end.value == LocalRows(codes, 64, 1.0).tree(g, h, rule) and count <= 20


@pytest.mark.parametrize("name", list(FITS))
def test_long_series_are_searched(train, name, monkeypatch):
    """A series over the limit has its settings chosen by the same search: the same model, number by number."""
    monkeypatch.setattr(series_trees, "WRITE_ROUNDS", 2)
    whole = lambda low, high: proposals.Range(low, high, whole=True)
    ranges = {"trees": whole(3, 5), "rate": proposals.Range(0.1, 0.5, log=True), "leaves": whole(2, 5), "depth": whole(1, 4), "min_leaf": whole(2, 20),
              "rows": proposals.Range(0.6, 1.0), "columns": proposals.Range(0.6, 1.0)}
    search = {"RandomForest": {"grid": {"trees": [2], "depth": [1, 3], "min_split": [2], "min_leaf": [1, 9]}, "draws": 3},
              "BoostedA": {"grid": {"trees": [3, 5], "rate": [0.1, 0.5], "depth": [1, 2], "rows": [0.8], "columns": [0.7]}, "draws": 3},
              "BoostedB": {"trials": 11, "ranges": ranges}}[name]
    own, names = train.filter("series_id = 'b'").select("series_id", "ts", "y", *NAMES[:6]).repartition(3), NAMES[:6]
    fit, given = FITS[name]
    one = fit(own, names, params=given, **search)
    many = fit(own, names, params=given, group_rows=100, **search)
    assert table_of(one) == table_of(many)
    plain = fit(own, names, params=given, tune=False)
    assert many.table.first()["params"] != plain.table.first()["params"]


def test_bin_edges_come_from_all_rows(spark):
    """Over 200,000 rows too: every value of a column has its part in the edges, in one task and in many."""
    n = 300_000
    rows = spark.range(n).select(F.col("id").alias("_i"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("x"))
    for edges in (series_trees.binned("BoostedA", np.arange(n, dtype=float)[:, None], None)[0], series_trees._edges(rows, n, ["x"], 256)):
        np.testing.assert_array_equal(edges[0], [-(-n * j // 256) - 1 for j in range(1, 256)])
