"""Train several models, score them per series and keep the best one."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.config import DEFAULTS, Config
from wattline.models.arima import fit_arima
from wattline.models.linear import fit_linear
from wattline.models.series_trees import fit_series_boosted_a, fit_series_boosted_b, fit_series_forest
from wattline.operators.forecast import forecast_horizons
from wattline.operators.metrics import metrics_table
from wattline.operators.ordering import head, positions
from wattline.operators.reports import safe_concat
from wattline.session import reliable

log = logging.getLogger(__name__)

FEATURE_MODELS: dict[str, Callable[..., Any]] = {
    "LinearRegression": lambda df, features, **kw: fit_linear(df, features),
    "RandomForest": fit_series_forest,
    "BoostedA": fit_series_boosted_a,
    "BoostedB": fit_series_boosted_b,
}
STATISTICAL_MODELS = ("ARIMA", "SARIMA", "SARIMAX")
ALL_MODELS = (*FEATURE_MODELS, *STATISTICAL_MODELS)


@dataclass
class Selection:
    """Fitted models, their metrics and the best model per series."""

    metrics: DataFrame
    best: DataFrame
    models: dict[str, Any] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def forecast(self, history: DataFrame, *, exog: Sequence[str] = (), cfg: Config = DEFAULTS) -> DataFrame:
        """Forecast every series with its own best model."""
        used = [r["model"] for r in self.best.select("model").distinct().collect()]  # at most one per model kind
        parts = []
        for name in used:
            rows = history.join(self.best.filter(F.col("model") == name).select("series_id"), "series_id", "left_semi")
            points = forecast_horizons(rows, self.models[name], exog=exog, cfg=cfg)
            parts.append(points.withColumn("model", F.lit(name)))
        return safe_concat(parts)


def evaluate(model, test: DataFrame, *, target: str = "y", digits: int | None = None) -> DataFrame:
    """Metrics of a fitted model on held-out rows, one row per series."""
    if model is None:
        raise ValueError("model is not fitted")
    scored = evaluate_points(model, test, target=target)
    return metrics_table(scored.withColumn("model", F.lit(model.name)), actual=target, digits=digits)


def evaluate_points(model, test: DataFrame, *, target: str = "y") -> DataFrame:
    if not model.statistical:
        return model.transform(test)
    ranked = positions(test, ["series_id"], ["ts"], pos="_i").withColumn("step", (F.col("_i") + 1).cast("int"))
    future = ranked.select("series_id", "ts", *model.exog, "step")
    points = model.forecast(None, 0, future=future).select("series_id", "step", F.col("forecast").alias("prediction"))
    return ranked.join(points, ["series_id", "step"])


def select_best(metrics: DataFrame, *, by: str = "rmse") -> DataFrame:
    """The model with the lowest error per series (ties by name)."""
    best = metrics.groupBy("series_id").agg(F.min(F.struct(by, "model")).alias("b"))
    return best.select("series_id", F.col("b.model").alias("model"), F.col(f"b.{by}").alias(by))


def run(
    train: DataFrame, test: DataFrame, features: Sequence[str], *, exog: Sequence[str] = (),
    enabled: Sequence[str] = ALL_MODELS, options: dict[str, dict] | None = None, skip_statistical: bool = False,
    cfg: Config = DEFAULTS,
) -> Selection:
    """Fit the enabled models on ``train`` and compare them on ``test``; a model that fails
    is logged and left out, and none left is an error.

    ``options`` are keyword arguments per model name. All models see the same rows; statistical ones the
    newest training and first test rows only where the configuration says how many. Models that
    failed are named in ``failed``."""
    options = options or {}
    fitted: dict[str, Any] = {}
    failed: dict[str, str] = {}
    parts: list[DataFrame] = []
    for name in enabled:
        if name not in ALL_MODELS:
            raise ValueError(f"unknown model {name!r}")
        if name in STATISTICAL_MODELS and skip_statistical:
            continue
        try:
            if name in FEATURE_MODELS:
                model, rows = FEATURE_MODELS[name](train, features, **options.get(name, {})), test
            else:
                model = fit_arima(train, name=name, exog=exog, max_rows=cfg.stat_train_rows, **options.get(name, {}))
                rows = test if cfg.stat_test_rows is None else head(test, cfg.stat_test_rows)
            # a few numbers per series, fixed here so that a failing model shows now
            parts.append(reliable(evaluate(model, rows)))
            fitted[name] = model
        except Exception as error:
            log.exception("model %s failed", name)
            failed[name] = f"{type(error).__name__}: {error}"
    if not fitted:
        raise RuntimeError("no model could be trained")
    metrics = safe_concat(parts)
    return Selection(metrics, select_best(metrics), fitted, failed)


def predict_raw(model, rows: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Predict given feature rows; features that were not sent count as 0.0."""
    from wattline.operators.features import fill_missing_features

    if model.statistical:
        raise ValueError(f"raw prediction needs a feature model, not {model.name}; use a forecast")
    return model.transform(fill_missing_features(rows, model.features, keep=["series_id", *keep]))
