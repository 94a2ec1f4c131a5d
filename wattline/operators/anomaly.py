"""Anomaly flags: z-score and IQR fences, three model-based methods, and their vote."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.config import DEFAULTS, Config
from wattline.functions.calendar import calendar_columns
from wattline.operators import one_class, outlier_models
from wattline.operators.ordering import choose_plan, quantiles, tail
from wattline.operators.reports import anomaly_rate, method_breakdown, severity
from wattline.session import reliable

log = logging.getLogger(__name__)

EPSILON = 1e-8


def zscore_flags(
    df: DataFrame, *, series: str = "series_id", target: str = "y", threshold: float = 3.0, out: str = "anomaly_zscore"
) -> DataFrame:
    """1 where the distance from the series mean exceeds ``threshold`` sample deviations."""
    stats = df.groupBy(series).agg(F.avg(target).alias("_m"), F.stddev_samp(target).alias("_s"))
    z = F.abs((F.col(target) - F.col("_m")) / (F.col("_s") + F.lit(EPSILON)))
    flag = F.coalesce((z > F.lit(float(threshold))).cast("int"), F.lit(0))
    return df.join(stats, series, "left").withColumn(out, flag).drop("_m", "_s")


def iqr_flags(
    df: DataFrame, *, series: str = "series_id", target: str = "y", k: float = 1.5, out: str = "anomaly_iqr",
    plan: str = "auto",
) -> DataFrame:
    """1 strictly outside the quartile fences."""
    q = quantiles(df, target, {"_q1": 0.25, "_q3": 0.75}, keys=[series], plan=plan)
    spread = (F.col("_q3") - F.col("_q1")) * F.lit(k)
    y = F.col(target)
    outside = (y < F.col("_q1") - spread) | (y > F.col("_q3") + spread)
    flag = F.coalesce(outside.cast("int"), F.lit(0))
    return df.join(q, series, "left").withColumn(out, flag).drop("_q1", "_q3")


def statistical_flags(
    df: DataFrame, *, series: str = "series_id", target: str = "y", methods: Sequence[str] = ("zscore", "iqr"),
    cfg: Config = DEFAULTS, plan: str = "auto",
) -> DataFrame:
    """Both one-dimensional flags from one aggregate and one join when the series are small
    enough to hold their values in a buffer each; else one method after the other."""
    plan = choose_plan(df, [series], plan)
    if plan == "chunked" or len(methods) < 2:
        out = df
        if "zscore" in methods:
            out = zscore_flags(out, series=series, target=target, threshold=cfg.zscore_threshold)
        if "iqr" in methods:
            out = iqr_flags(out, series=series, target=target, k=cfg.iqr_multiplier, plan=plan)
        return out
    stats = df.groupBy(series).agg(
        F.avg(target).alias("_m"), F.stddev_samp(target).alias("_s"),
        F.percentile(target, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
    )
    y, (q1, q3) = F.col(target), (F.col("_q")[0], F.col("_q")[1])
    z = F.abs((y - F.col("_m")) / (F.col("_s") + F.lit(EPSILON)))
    spread = (q3 - q1) * F.lit(cfg.iqr_multiplier)
    flags = {"zscore": z > F.lit(cfg.zscore_threshold), "iqr": (y < q1 - spread) | (y > q3 + spread)}
    out = df.join(stats, series, "left")
    out = out.withColumns({f"anomaly_{m}": F.coalesce(flags[m].cast("int"), F.lit(0)) for m in methods})
    return out.drop("_m", "_s", "_q")


def _feature_columns(df: DataFrame, exog: Sequence[str], ts: str, target: str) -> list:
    parts = calendar_columns(F.col(ts), holidays=False)
    cols = [F.col(target), parts["hour_sin"], parts["hour_cos"], parts["is_weekend"].cast("double")]
    return cols + [F.coalesce(F.col(c), F.lit(0.0)) for c in exog if c in df.columns]


def standardised(
    df: DataFrame, *, exog: Sequence[str] = (), series: str = "series_id", ts: str = "ts", target: str = "y",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows with a target as ``series, ts, x``: target, sine and cosine of the hour, weekend
    flag and exogenous values (null as 0), each scaled by its population deviation."""
    cols = _feature_columns(df, exog, ts, target)
    n = len(cols)
    raw = df.filter(F.col(target).isNotNull()).select(series, ts, *keep, *[c.alias(f"_x{i}") for i, c in enumerate(cols)])
    stats = raw.groupBy(series).agg(
        *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(n)], *[F.stddev_pop(f"_x{i}").alias(f"_s{i}") for i in range(n)]
    )
    scale = lambda i: F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)
    x = F.array(*[(F.col(f"_x{i}") - F.col(f"_m{i}")) / scale(i) for i in range(n)])
    return raw.join(stats, series).select(series, ts, *keep, x.alias("x"))


def points(flagged: DataFrame, *, series: str = "series_id", ts: str = "ts", target: str = "y") -> DataFrame:
    """Reading, verdict, score and severity of every row."""
    hit = F.col("is_anomaly") == 1
    return flagged.select(
        series, ts, F.col(target).alias("value"), hit.alias("is_anomaly"),
        F.round("anomaly_score", 4).alias("anomaly_score"), severity(F.col("anomaly_score"), hit).alias("severity"),
    )


def report_points(flagged: DataFrame, *, last: int | None = None, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """All points, or the newest ``last`` of each series."""
    rows = flagged if last is None else tail(flagged, last, series=series, ts=ts)
    return points(rows, series=series, ts=ts)


def vote(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Share of methods that flag a row, and the majority verdict."""
    total = sum((F.col(f"anomaly_{m}") for m in methods), F.lit(0))
    out = df.withColumn("anomaly_score", total / F.lit(float(len(methods))))
    return out.withColumn("is_anomaly", (F.col("anomaly_score") >= 0.5).cast("int"))


def detect(
    df: DataFrame, *, methods: Sequence[str] | None = None, exog: Sequence[str] = (), series: str = "series_id",
    ts: str = "ts", target: str = "y", cfg: Config = DEFAULTS, skip_failed: bool = False,
) -> DataFrame:
    """Input rows with one ``anomaly_<method>`` flag per method, score and verdict.

    An unknown method raises. ``skip_failed`` leaves out a method whose plan cannot be
    built instead of raising. Rows with a null target are never flagged.

    The model-based methods read the input several times, so it is checkpointed once for
    them; their flags join back on (series, time), which must be unique."""
    methods = list(methods or cfg.anomaly_methods)
    unknown = [m for m in methods if m not in ROW_METHODS and m not in MODEL_METHODS]
    if unknown:
        raise ValueError(f"unknown anomaly methods: {unknown}")
    rows = [m for m in methods if m in ROW_METHODS]
    modelled = [m for m in methods if m in MODEL_METHODS]
    plan = choose_plan(df, [series])
    out = statistical_flags(df, series=series, target=target, methods=rows, cfg=cfg, plan=plan) if rows else df
    used = list(rows)
    if modelled:
        base = reliable(df.select(series, ts, target, *outlier_models.used_exog(df, exog)))
    for method in modelled:
        name = f"anomaly_{method}"
        try:
            flags = MODEL_METHODS[method](base, exog=exog, series=series, ts=ts, target=target, cfg=cfg, plan=plan)
        except Exception:
            if not skip_failed:
                raise
            log.exception("method %s failed", method)
            continue
        out = out.join(flags, [series, ts], "left").withColumn(name, F.coalesce(name, F.lit(0)))
        used.append(method)
    return vote(out, used) if used else out


def summary(flagged: DataFrame) -> DataFrame:
    """Flags per method."""
    return method_breakdown(flagged)


def overall(flagged: DataFrame) -> DataFrame:
    return anomaly_rate(flagged)


def _scored(df, exog, series, ts, target, plan):
    """Features, their count and the plan for the cut-off quantile, sized on the input."""
    exog = outlier_models.used_exog(df, exog)
    x = standardised(df, exog=exog, series=series, ts=ts, target=target)
    return x, 4 + len(exog), choose_plan(df, [series], plan)


def isolation_forest_flags(
    df: DataFrame, *, exog: Sequence[str] = (), series: str = "series_id", ts: str = "ts", target: str = "y",
    trees: int = 100, contamination: float = 0.05, seed: int = 42, plan: str = "auto",
) -> DataFrame:
    """Flags ``(series, ts, flag)``: 1 for the most isolated share of each series."""
    x, _, plan = _scored(df, exog, series, ts, target, plan)
    scores = reliable(outlier_models.isolation_scores(x, trees=trees, seed=seed, series=series, ts=ts))
    name = "anomaly_isolation_forest"
    return outlier_models.flag_top_share(scores, contamination, name, value="score", series=series, ts=ts, plan=plan)


def lof_scores(
    df: DataFrame, *, exog: Sequence[str] = (), series: str = "series_id", ts: str = "ts", target: str = "y",
    neighbors: int = 20, **kw,
) -> DataFrame:
    x, dims, _ = _scored(df, exog, series, ts, target, "plain")
    return outlier_models.lof_scores(x, dims, neighbors=neighbors, series=series, ts=ts, **kw)


def lof_flags(
    df: DataFrame, *, exog: Sequence[str] = (), series: str = "series_id", ts: str = "ts", target: str = "y",
    neighbors: int = 20, contamination: float = 0.05, plan: str = "auto",
) -> DataFrame:
    """Flags: 1 for the largest local outlier factors of each series."""
    x, dims, plan = _scored(df, exog, series, ts, target, plan)
    scores = reliable(outlier_models.lof_scores(x, dims, neighbors=neighbors, series=series, ts=ts))
    return outlier_models.flag_top_share(scores, contamination, "anomaly_lof", value="lof", series=series, ts=ts, plan=plan)


def one_class_svm_flags(
    df: DataFrame, *, exog: Sequence[str] = (), series: str = "series_id", ts: str = "ts", target: str = "y",
    nu: float = 0.05, seed: int = 42, plan: str = "auto",
) -> DataFrame:
    """Flags: 1 for the share ``nu`` furthest outside the fitted region of each series."""
    x, dims, plan = _scored(df, exog, series, ts, target, plan)
    scores = reliable(one_class.one_class_scores(x, dims, nu=nu, seed=seed, series=series, ts=ts))
    name = "anomaly_one_class_svm"
    return outlier_models.flag_top_share(scores, nu, name, value="score", series=series, ts=ts, plan=plan)


ROW_METHODS = ("zscore", "iqr")
MODEL_METHODS = {
    "isolation_forest": lambda df, cfg, **kw: isolation_forest_flags(
        df, trees=cfg.forest_trees, contamination=cfg.contamination, seed=cfg.seed, **kw),
    "lof": lambda df, cfg, **kw: lof_flags(df, neighbors=cfg.lof_neighbors, contamination=cfg.contamination, **kw),
    "one_class_svm": lambda df, cfg, **kw: one_class_svm_flags(df, nu=cfg.svm_nu, seed=cfg.seed, **kw),
}
