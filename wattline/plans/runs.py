"""Whole runs: train and publish, forecast with stored models, dry check, dashboard.

A run is one set of plans over all series at once. The clean frame and the feature
frame are checkpointed, since models, anomaly methods and rules all read them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.config import DEFAULTS, Config
from wattline.models import selection, store
from wattline.operators import anomaly, cleaning, explain, features, metrics, quality, recommend, reports
from wattline.operators.ordering import head
from wattline.session import reliable
from wattline.sources import records as stored
from wattline.sources import results
from wattline.sources.csv import ORDER


@dataclass
class Run:
    """Result frames of one run by name, beside the selection that made them."""

    chosen: selection.Selection
    tables: dict[str, DataFrame] = field(default_factory=dict)


def prepare(
    df: DataFrame, *, exog: Sequence[str] = (), ingest_order: str | None = None, cfg: Config = DEFAULTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Input to ``(clean, features, rejected)``, all written once.

    Every series is checked by itself. One that is too short, has no target or is too short for
    a feature row is named in ``rejected`` with its reason and the others go on; none left is an error."""
    quality.validate(df, required=("ts", "y", *exog), min_rows=1)
    refused = reliable(quality.rejected(df, min_rows=cfg.min_rows))
    clean = reliable(cleaning.clean(df.join(refused, "series_id", "left_anti"), ingest_order=ingest_order, cfg=cfg))
    rows = reliable(features.transform(clean, exog=exog, cfg=cfg))
    short = clean.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.avg(F.col("y").isNull().cast("int")) * 100).alias("null_pct"))
    short = short.join(rows.select("series_id").distinct(), "series_id", "left_anti").withColumn("reason", F.lit("too short for the features"))
    if rows.isEmpty():
        raise quality.ValidationError("validation failed: no series is left to train on")
    return clean, rows, reliable(refused.unionByName(short))


def train(
    feature_rows: DataFrame, *, exog: Sequence[str] = (), enabled: Sequence[str] = selection.ALL_MODELS,
    options: dict | None = None, skip_statistical: bool = False, cfg: Config = DEFAULTS,
) -> selection.Selection:
    split = reliable(metrics.time_split(feature_rows, test_size=cfg.test_size))
    return selection.run(
        split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split"),
        features.feature_names(exog, cfg), exog=exog, enabled=enabled, options=options,
        skip_statistical=skip_statistical, cfg=cfg,
    )


def best_explanations(
    chosen: selection.Selection, feature_rows: DataFrame, *, max_rows: int | None, exog: Sequence[str] = (), cfg: Config = DEFAULTS, **kw
) -> DataFrame | None:
    """Importances of every series under its own best model; where that is a statistical one, under a linear model fitted to the
    series' rows."""
    parts = []
    for name, model in chosen.models.items():
        rows = feature_rows.join(chosen.best.filter(F.col("model") == name).select("series_id"), "series_id", "left_semi")
        kind = explain.explainer_kind(model)
        _, shap = explain.explain(rows, model, features=features.feature_names(exog, cfg), max_rows=max_rows, **(kw if kind == "KernelExplainer" else {}))
        parts.append(explain.importance(shap))
    return reports.safe_concat(parts) if parts else None


def full_run(
    df: DataFrame, *, exog: Sequence[str] = (), enabled: Sequence[str] = selection.ALL_MODELS, options: dict | None = None,
    methods: Sequence[str] | None = None, explained: bool = True, skip_statistical: bool = False,
    skip_training: bool = False, models_folder: str | None = None, out_folder: str | None = None,
    ingest_order: str | None = None, raw_anomalies: bool = False, kernel_budget: int = 512, cfg: Config = DEFAULTS,
) -> Run:
    """Validate, clean, build features, select models, forecast, flag anomalies, explain and
    recommend; save models and results where folders are given.

    ``skip_training`` loads the models of an earlier run from ``models_folder``.
    ``raw_anomalies`` looks for anomalies before capping outliers: capping at the fences
    leaves nothing for the fence method to find."""
    clean, feature_rows, refused = prepare(df, exog=exog, ingest_order=ingest_order, cfg=cfg)
    if skip_training:
        chosen = load_selection(df.sparkSession, models_folder)
    else:
        chosen = train(feature_rows, exog=exog, enabled=enabled, options=options, skip_statistical=skip_statistical, cfg=cfg)
        if models_folder:
            save_selection(chosen, models_folder)
    forecasts = reliable(chosen.forecast(clean, exog=exog, cfg=cfg))
    accepted = df.join(refused, "series_id", "left_anti")
    checked = cleaning.clean(accepted, ingest_order=ingest_order, winsorized=False, cfg=cfg) if raw_anomalies else clean
    flagged = reliable(anomaly.detect(checked, methods=methods, exog=exog, cfg=cfg))
    importance = best_explanations(chosen, feature_rows, max_rows=cfg.explain_rows, exog=exog, cfg=cfg, budget=kernel_budget) if explained else None
    importance = reliable(importance) if importance is not None else None
    shortest = min(cfg.horizons, key=cfg.horizons.get)
    recs = recommend.generate(forecasts.filter(F.col("horizon") == shortest), clean, flagged, importance, cfg=cfg)
    tables = {
        "forecasts": forecasts, "anomalies": flagged, "recommendations": recs,
        "metadata": results.metadata(chosen.metrics, chosen.best).withColumn("failed_models", F.lit(sorted(chosen.failed)).cast("array<string>")),
        "rejected": refused,
    }
    if importance is not None:
        tables["importance"] = reports.importance_ranked(importance)
    if out_folder:
        results.write_features(feature_rows, f"{out_folder}/features")
        results.write_results({k: v for k, v in tables.items() if k != "metadata"}, out_folder)
        results.write_json(tables["metadata"], f"{out_folder}/metadata")
    return Run(chosen, tables)


def save_selection(chosen: selection.Selection, folder: str) -> None:
    for name, model in chosen.models.items():
        store.save_model(model, folder, name)
    chosen.best.write.mode("overwrite").parquet(f"{folder}/best")
    chosen.metrics.write.mode("overwrite").parquet(f"{folder}/metrics")


def load_selection(spark: SparkSession, folder: str | None) -> selection.Selection:
    if folder is None:
        raise ValueError("a models folder is needed to skip training")
    best = spark.read.parquet(f"{folder}/best")
    names = [n for n in selection.ALL_MODELS if store.model_exists(spark, folder, n)]
    return selection.Selection(
        spark.read.parquet(f"{folder}/metrics"), best, {n: store.load_model(spark, folder, n) for n in names}
    )


def summary(run: Run) -> DataFrame:
    """One row per series: best model, error, forecast points, anomalies, recommendations."""
    points = run.tables["forecasts"].groupBy("series_id").agg(F.count(F.lit(1)).alias("forecast_points"))
    hits = reports.anomaly_rate(run.tables["anomalies"], keys=("series_id",))
    recs = reports.priority_counts(run.tables["recommendations"]).select("series_id", F.col("total").alias("recommendations"))
    return run.chosen.best.join(points, "series_id").join(hits, "series_id").join(recs, "series_id")


def dry_run(
    df: DataFrame, *, rows: int = 2000, exog: Sequence[str] = (), ingest_order: str | None = None, cfg: Config = DEFAULTS
) -> DataFrame:
    """Load, validate, clean and build features on the first rows of each series; row
    counts per stage."""
    part = head(df, rows)
    clean, feature_rows, _ = prepare(part, exog=exog, ingest_order=ingest_order, cfg=cfg)
    stages = {"loaded": part, "clean": clean, "features": feature_rows}
    return reports.safe_concat([
        s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("stage", F.lit(n)) for n, s in stages.items()
    ])


def owner_run(
    records: DataFrame, *, limit: int | None = None, publish_folder: str | None = None, run_id: str | None = None, **kw
) -> Run:
    """Train on the stored readings of every owner at once and publish forecasts and
    recommendations as that run's version. No attributions are made here. Where records hold their order, the first
    of copied times stays."""
    order = ORDER if ORDER in records.columns else None
    run = full_run(stored.as_series(records, limit=limit, ingest_order=order), explained=False, ingest_order=order, **kw)
    if publish_folder:
        run_id = run_id or uuid.uuid4().hex
        best = run.chosen.best.join(run.chosen.metrics, ["series_id", "model", "rmse"])
        packed = results.to_forecast_map(run.tables["forecasts"], keys=("series_id", "horizon", "model"))
        results.publish(packed.join(best, ["series_id", "model"], "left"), f"{publish_folder}/forecasts", run_id=run_id)
        results.publish(run.tables["recommendations"], f"{publish_folder}/recommendations", run_id=run_id)
    return run


def dashboard(records: DataFrame, publish_folder: str, *, first_n: int | None = None) -> dict[str, DataFrame]:
    """Statistics per owner with best model and horizons, next-day points, top recommendations."""
    spark = records.sparkSession
    latest = results.read_latest(spark, f"{publish_folder}/forecasts")
    recs = results.read_latest(spark, f"{publish_folder}/recommendations")
    shown = latest.groupBy("series_id").agg(
        F.array_sort(F.collect_set("horizon")).alias("horizons"), F.first("model").alias("best_model")
    )
    counts = reports.priority_counts(recs).select(
        "series_id", F.col("total").alias("recommendations"), "high_priority"
    )
    stats = reports.dashboard_stats(records, first_n=first_n).join(shown, "series_id", "left").join(counts, "series_id", "left")
    one = latest.groupBy("series_id").agg(F.min_by("forecast_data", F.struct("created_at", "horizon")).alias("forecast_data"))
    return {
        "stats": stats,
        "next_day": head(results.from_forecast_map(one), 24),
        "top_recommendations": reports.top_recommendations(recs),
    }
