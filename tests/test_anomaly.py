import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import frame, raw, sorted_pdf, spikes
from wattline.operators import anomaly, reports
from wattline.operators.neighbours import knn
from wattline.operators.one_class import fit_one_class, one_class_scores, responses, solve_dual
from wattline.operators.outlier_models import one_class_direction


@pytest.fixture(scope="module")
def flagged(spark):
    return sorted_pdf(anomaly.detect(frame(spark, spikes())))


def test_every_spike_is_found(flagged):
    hit = flagged.iloc[[50, 150, 300, 400]]
    for c in ("anomaly_zscore", "anomaly_iqr", "anomaly_isolation_forest", "anomaly_lof", "is_anomaly"):
        assert (hit[c] == 1).all(), c


def test_model_methods_flag_their_share(flagged):
    for m in ("isolation_forest", "lof", "one_class_svm"):
        assert abs(flagged[f"anomaly_{m}"].mean() - 0.05) <= 0.01, m
    assert len(flagged) == 500


def test_normal_data_stays_under_thirty_percent(spark):
    rng = np.random.default_rng(77)
    pdf = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2021-01-01", periods=800, freq="h"), "y": rng.normal(50000, 1500, 800)})
    rate = reports.anomaly_rate(anomaly.detect(frame(spark, pdf), methods=["zscore", "iqr", "isolation_forest"])).first()
    assert rate["anomaly_rate_pct"] < 30


def test_scores_do_not_depend_on_partitioning(spark):
    df = frame(spark, raw(300))
    a = sorted_pdf(anomaly.isolation_forest_flags(df, trees=20, exog=["solar"]))
    b = sorted_pdf(anomaly.isolation_forest_flags(df.repartition(7), trees=20, exog=["solar"]))
    pd.testing.assert_frame_equal(a, b)


def test_null_target_is_never_flagged(spark):
    pdf = spikes()
    pdf.loc[[0, 1], "y"] = None
    out = sorted_pdf(anomaly.detect(frame(spark, pdf), methods=["zscore", "iqr", "lof"]))
    assert len(out) == 500 and out.loc[[0, 1], "is_anomaly"].sum() == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        anomaly.detect(frame(spark, spikes()), methods=["nope"])


def test_severity_levels(spark):
    df = spark.createDataFrame([(0.9, 1), (0.6, 1), (0.4, 0)], "s double, a int")
    out = df.select(reports.severity(F.col("s"), F.col("a")).alias("v")).collect()
    assert [r["v"] for r in out] == ["high", "medium", "none"]


@pytest.mark.parametrize("plan", ["plain", "chunked"])
def test_neighbours_match_brute_force(spark, plan):
    """Clusters, exact copies and far points, over several leaves."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.1, (150, 3)), rng.normal(2, 1.0, (150, 3)), np.repeat(rng.normal(0, 1, (1, 3)), 60, axis=0), [[9, 9, 9], [-8, 0, 3]]])
    df = spark.createDataFrame([("s", i, [float(v) for v in row]) for i, row in enumerate(x)], "series_id string, id long, x array<double>")
    got = {r["id"]: [(e["dist"], e["nbr"]) for e in r["near"]] for r in knn(df, 5, 3, leaf_rows=16, plan=plan).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(x)
    for i in range(len(x)):
        want = np.sort(d[i])[:5]
        np.testing.assert_allclose([g[0] for g in got[i]], want, atol=1e-12)
        assert all(n != i for _, n in got[i]) and len({n for _, n in got[i]}) == 5


def test_one_class_direction_separates_far_points():
    rng = np.random.default_rng(0)
    phi = np.abs(np.vstack([rng.normal(1, 0.1, (200, 4)), rng.normal(0, 0.01, (4, 4))]))
    w = one_class_direction(phi, 0.05)
    assert (phi @ w)[-4:].max() <= np.quantile(phi @ w, 0.05)


def test_one_class_in_buckets_is_that_of_all_rows(spark):
    """Buckets, merges and mending end at the optimum of all rows, copies and far points included."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(4, 0.3, (80, 3)), np.repeat([[1.0, 1.0, 1.0]], 15, axis=0), [[9, 9, 9], [-8, 0, 3]]])
    rows = [(s, i, [float(v) for v in row]) for s in ("a", "b") for i, row in enumerate(x if s == "a" else x[:3])]
    df = spark.createDataFrame(rows, "series_id string, ts long, x array<double>")
    n, nu = len(x), 0.1
    weight, rho = solve_dual(x, np.full(n, nu), 1 / 3, 1e-6)
    want = responses(x, x, weight, 1 / 3)
    assert weight.min() >= 0 and weight.max() <= 1 and weight.sum() == pytest.approx(nu * n)
    assert (want[weight == 0] >= rho - 1e-5).all() and (want[weight == 1] <= rho + 1e-5).all()
    for solve_rows in (8192, 150):
        machines = fit_one_class(df, 3, nu=nu, solve_rows=solve_rows).filter("series_id = 'a'").toPandas()
        assert machines["part"].nunique() == 1 and machines["weight"].sum() == pytest.approx(nu * n)
        got = responses(x, np.stack(machines["x"]), machines["weight"].to_numpy(), 1 / 3)
        np.testing.assert_allclose(got, want, atol=0.05)
        assert abs(machines["rho"].iloc[0] - rho) < 0.02


def test_one_class_of_many_machines_scores_every_row(spark):
    """Support vectors that no task may hold together: far points still score highest."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (600, 2)), [[9, 9], [-9, 7]]])
    df = spark.createDataFrame([("s", i, [float(v) for v in row]) for i, row in enumerate(x)], "series_id string, ts long, x array<double>")
    assert fit_one_class(df, 2, nu=0.2, solve_rows=40).select("part").distinct().count() > 1
    scores = {r["ts"]: r["score"] for r in one_class_scores(df, 2, nu=0.2, solve_rows=40).collect()}
    assert len(scores) == len(x) and min(scores[600], scores[601]) >= np.quantile(list(scores.values()), 0.9)
    assert one_class_scores(df.limit(0), 2).count() == 0
