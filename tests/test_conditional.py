"""Conditional least squares: planted models, tied cross lags, chunks."""

import numpy as np
import pandas as pd
import pytest

from wattline.models.arima import expanded_lags, fit_arima
from wattline.models.conditional import Factors, fit_rows

ORDER, SEASON = (1, 1, 1), (1, 1, 1, 24)
PLANTED = (0.5, 0.3, -0.4, -0.6)  # short and seasonal autoregression, short and seasonal moving average


def planted(n, seed, truth=PLANTED):
    rng = np.random.default_rng(seed)
    factors = Factors(ORDER, SEASON, expanded_lags(1, 1, 24), expanded_lags(1, 1, 24), 0)
    coef, lags = factors.expanded(np.array(truth)), np.array([1, 24, 25])
    w, e = np.zeros(n + 25), rng.normal(0, 1, n + 25)
    for t in range(25, n + 25):
        w[t] = coef[:3] @ w[t - lags] + coef[3:] @ e[t - lags] + e[t]
    y = np.zeros(n + 25)
    for t in range(25, n + 25):
        y[t] = w[t] + y[t - 1] + y[t - 24] - y[t - 25]
    return y[25:]


def table(spark, lengths):
    parts = [pd.DataFrame({"series_id": s, "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "y": planted(n, seed)}) for seed, (s, n) in enumerate(lengths.items())]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True)).cache()


def test_planted_model_is_recovered_and_tied(spark):
    model = fit_arima(table(spark, {"a": 4000, "b": 3000}), name="SARIMA")
    for row in model.table.collect():
        a1, a24, a25, m1, m24, m25 = row["coef"]
        np.testing.assert_allclose((a1, a24, m1, m24), PLANTED, atol=0.1)
        assert a25 == pytest.approx(-a1 * a24, abs=1e-12) and m25 == pytest.approx(m1 * m24, abs=1e-12)


def test_chunks_of_rows_equal_the_whole(spark):
    df = table(spark, {"a": 900, "b": 400})
    whole = {r.series_id: r.coef for r in fit_arima(df, name="SARIMA").table.collect()}
    cut = {r.series_id: r.coef for r in fit_arima(df, name="SARIMA", step_rows=370).table.collect()}
    assert cut.keys() == whole.keys() == {"a", "b"}
    for s in whole:
        np.testing.assert_allclose(cut[s], whole[s], atol=1e-5)


@pytest.mark.parametrize("q", [1, 2])
def test_least_squares_beat_their_neighbours(q):
    rng = np.random.default_rng(q)
    e = rng.normal(size=600)
    rows = (e + 0.5 * np.r_[0, e[:-1]] + (0.3 * np.r_[0, 0, e[:-2]] if q == 2 else 0))[:, None]
    factors = Factors((0, 0, q), (0, 0, 0, 0), [], list(range(1, q + 1)), 0)

    def squares(params):
        out = factors.innovations(rows, factors.expanded(np.asarray(params))[None, :], np.zeros((q, 1)))
        return float((out ** 2).sum())

    got = fit_rows(factors, rows, np.zeros(q))
    assert squares(got) < squares(np.zeros(q))
    for k in range(q):
        for move in (-1e-3, 1e-3):
            assert squares(got) < squares(got + move * np.eye(q)[k])


def test_starts_are_invertible():
    factors = Factors(ORDER, SEASON, [1, 24, 25], [1, 24, 25], 1)
    start = factors.start(np.array([0.2, 0.1, 9.0, 1.7, -2.0, 5.0, 3.0]))
    assert factors.invertible(start) and start[0] == 0.2 and start[-1] == 3.0
    expanded = factors.expanded(start)
    assert expanded[2] == pytest.approx(-0.02) and expanded[5] == pytest.approx(start[2] * start[3])
