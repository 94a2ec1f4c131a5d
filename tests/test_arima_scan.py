"""Forecasts in chunks equal the sequential recursion, at any length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import frame, raw
from wattline.models import selection
from wattline.models.arima import LinearSteps, difference_weights, fit_arima


@pytest.fixture(scope="module")
def history(spark):
    return frame(spark, pd.concat([raw(700, 0, series="a"), raw(500, 5, series="b")], ignore_index=True)).cache()


@pytest.mark.parametrize("name, order", [("ARIMA", None), ("ARIMA", (0, 1, 0)), ("ARIMA", (2, 0, 0)), ("SARIMA", None), ("SARIMAX", None)])
def test_chunks_equal_the_recursion(history, name, order):
    exog = [c for c in history.columns if c not in ("series_id", "ts", "y")][:2] if name == "SARIMAX" else []
    model = fit_arima(history, name=name, order=order, exog=exog)
    long = model.forecast(history, 901, chunk_steps=10_000).toPandas().sort_values(["series_id", "step"])
    cut = model.forecast(history, 901, chunk_steps=200).toPandas().sort_values(["series_id", "step"])
    assert len(cut) == len(long) == 1802 and (cut["ts"].to_numpy() == long["ts"].to_numpy()).all()
    np.testing.assert_allclose(cut["forecast"], long["forecast"], rtol=1e-6, atol=1e-6)


def test_evaluation_in_chunks(history, monkeypatch):
    """The test part of a series may be any length: no group is over a chunk."""
    cut = 600
    train, test = history.filter(F.col("ts") < F.lit("2020-01-10").cast("timestamp")), history.filter(F.col("ts") >= F.lit("2020-01-10").cast("timestamp"))
    assert train.count() and test.count() > cut
    model = fit_arima(train, name="ARIMA")
    want = {r.series_id: r.rmse for r in selection.evaluate(model, test).collect()}
    forecast = model.forecast
    monkeypatch.setattr(model, "forecast", lambda *a, **k: forecast(*a, **{**k, "chunk_steps": 50}))
    got = {r.series_id: r.rmse for r in selection.evaluate(model, test).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-6) for s in want)


def test_powers_carry_states():
    steps = LinearSteps([1, 2, 24], [1], difference_weights(1, 1, 24))
    rng = np.random.default_rng(0)
    coef = np.array([0.4, 0.2, 0.1, 0.3])
    state, given = rng.normal(size=steps.size), rng.normal(size=90)
    end, values = steps.run(coef, state, given)
    half, first = steps.run(coef, state, given[:40])
    zero, _ = steps.run(coef, np.zeros(steps.size), given[40:])
    np.testing.assert_allclose(np.linalg.matrix_power(steps.matrix(coef), 50) @ half + zero, end, rtol=1e-9)
    np.testing.assert_allclose(np.concatenate([first, steps.run(coef, half, given[40:])[1]]), values)
