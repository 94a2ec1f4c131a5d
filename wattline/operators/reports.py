"""Dashboard aggregates, listings and chart slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.operators.ordering import head, positions, tail

# Actual points shown before a forecast, by horizon.
CONTEXT_POINTS = {"24h": 48, "7d": 168, "30d": 336}


def safe_concat(frames: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union by name; an empty list gives an empty frame."""
    if not frames:
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame([], "series_id string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def downsample(
    df: DataFrame, max_points: int, *, series: str = "series_id", ts: str = "ts", plan: str = "auto"
) -> DataFrame:
    """Every ``ceil(n / max_points)``-th row per series, the first included."""
    ranked = positions(df, [series], [ts], pos="_i", total="_n", plan=plan)
    step = F.greatest(F.ceil(F.col("_n") / F.lit(max_points)), F.lit(1))
    return ranked.filter(F.col("_i") % step == 0).drop("_i", "_n")


def plot_context(
    history: DataFrame, forecast: DataFrame, *, horizon: str = "24h", series: str = "series_id",
    ts: str = "ts", target: str = "y",
) -> DataFrame:
    """The newest actuals for the horizon followed by the forecast rows."""
    actual = tail(history, CONTEXT_POINTS.get(horizon, 48), series=series, ts=ts)
    shape = lambda df, value, kind: df.select(series, ts, F.col(value).alias("value"), F.lit(kind).alias("kind"))
    return shape(actual, target, "actual").unionByName(shape(forecast, "forecast", "forecast"))


def dashboard_stats(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", value: str = "value", first_n: int | None = None
) -> DataFrame:
    """Record count over all rows; date range, mean, max and min over all rows, or over
    the oldest ``first_n`` when given."""
    total = df.groupBy(series).agg(F.count(F.lit(1)).alias("total_records"))
    part = df if first_n is None else head(df, first_n, series=series, ts=ts)
    stats = [
        F.min(ts).alias("date_range_start"), F.max(ts).alias("date_range_end"),
        F.round(F.avg(value), 2).alias("avg_consumption"),
        F.max(value).alias("max_consumption"), F.min(value).alias("min_consumption"),
    ]
    if first_n is None:
        return df.groupBy(series).agg(F.count(F.lit(1)).alias("total_records"), *stats)
    return total.join(part.groupBy(series).agg(*stats), series)


def priority_counts(recs: DataFrame, *, keys: tuple[str, ...] = ("series_id",), priority: str = "priority") -> DataFrame:
    count = lambda level: F.count_if(F.col(priority) == level)
    return recs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count("HIGH").alias("high_priority"),
        count("MEDIUM").alias("medium_priority"), count("LOW").alias("low_priority"),
    )


def method_breakdown(flagged: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Flag count per method, long form."""
    methods = methods or [
        c[len("anomaly_"):] for c in flagged.columns if c.startswith("anomaly_") and c != "anomaly_score"
    ]
    sums = flagged.agg(*[F.coalesce(F.sum(f"anomaly_{m}"), F.lit(0)).cast("long").alias(m) for m in methods])
    pairs = ", ".join(f"'{m}', `{m}`" for m in methods)
    return sums.selectExpr(f"stack({len(methods)}, {pairs}) as (method, count)")


def anomaly_rate(flagged: DataFrame, *, keys: tuple[str, ...] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    hits = F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long")
    return flagged.groupBy(*keys).agg(
        n.alias("total_records"), hits.alias("anomaly_count"),
        F.round(hits * 100.0 / F.greatest(n, F.lit(1)), 2).alias("anomaly_rate_pct"),
    )


def severity(score: Column, is_anomaly: Column) -> Column:
    level = F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    return F.when(is_anomaly.cast("boolean"), level).otherwise("none")


def anomaly_heatmap(flagged: DataFrame, *, ts: str = "ts") -> DataFrame:
    """7 x 24 grid of anomaly counts, Sunday first, with the share of the busiest cell."""
    spark = flagged.sparkSession
    grid = spark.range(7 * 24).select(
        F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour")
    )
    hits = (
        flagged.filter(F.col("is_anomaly") == 1)
        .groupBy((F.dayofweek(ts) - 1).alias("day"), F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    cells = grid.join(hits, ["day", "hour"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # 168 rows, whatever the input size.
    top = F.greatest(F.max("count").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return cells.withColumn("pct", F.col("count") / top)


def horizon_table(forecast: DataFrame, *, keys: tuple[str, ...] = ("series_id", "horizon")) -> DataFrame:
    """Points, mean, minimum and maximum forecast, and the peak upper bound per horizon."""
    return forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.avg("forecast").alias("avg_forecast"),
        F.min("forecast").alias("min_forecast"), F.max("forecast").alias("max_forecast"),
        F.max("upper_bound").alias("peak_load"),
    )


def hide_acknowledged(
    points: DataFrame, acknowledged: DataFrame, *, keys: tuple[str, ...] = ("series_id", "ts"), show: bool = False
) -> DataFrame:
    """Drop acknowledged points unless ``show``."""
    return points if show else points.join(acknowledged.select(*keys), list(keys), "left_anti")


def implemented_only(recs: DataFrame, implemented: DataFrame, *, key: str = "title") -> DataFrame:
    return recs.join(implemented.select(key), key, "left_semi")


def incident_list(
    points: DataFrame, acknowledged: DataFrame, *, severity_filter: str = "all", show_acknowledged: bool = True,
    limit: int | None = None, series: str = "series_id", ts: str = "ts",
) -> DataFrame:
    """Anomalous points with OPEN/RESOLVED status and a report line, oldest first."""
    marks = acknowledged.select(series, ts).distinct().withColumn("_ack", F.lit(True))
    rows = points.filter(F.col("is_anomaly").cast("boolean"))
    if severity_filter != "all":
        rows = rows.filter(F.col("severity") == severity_filter)
    rows = rows.join(marks, [series, ts], "left").withColumn(
        "status", F.when(F.col("_ack"), "RESOLVED").otherwise("OPEN")
    )
    if not show_acknowledged:
        rows = rows.filter(F.col("_ack").isNull())
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("Time: "), F.date_format(ts, "yyyy-MM-dd HH:mm")),
        F.concat(F.lit("Value: "), F.round("value").cast("long").cast("string")),
        F.concat(F.lit("Severity: "), F.upper("severity")),
        F.concat(F.lit("Score: "), F.round(F.col("anomaly_score") * 100).cast("long").cast("string"), F.lit("%")),
        F.concat(F.lit("Status: "), "status"),
    )
    out = rows.select(series, ts, "value", "anomaly_score", "severity", "status", line.alias("line"))
    return out if limit is None else out.orderBy(ts, series).limit(limit)


def system_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the count of each named frame, each counted by its own aggregate."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts).groupBy().pivot("name", list(tables)).agg(F.first("n"))


def upload_totals(uploads: DataFrame, *, last: int = 10, created: str = "created_at") -> DataFrame:
    """Totals over the newest uploads."""
    newest = uploads.orderBy(F.col(created).desc(), "upload_id").limit(last)
    return newest.agg(
        F.count(F.lit(1)).alias("uploads"), F.sum("rows_valid").alias("rows_valid"),
        F.sum("rows_rejected").alias("rows_rejected"),
    )


def top_recommendations(recs: DataFrame, *, n: int = 5, series: str = "series_id", created: str = "created_at") -> DataFrame:
    """Newest active recommendations per series."""
    w = Window.partitionBy(series).orderBy(F.col(created).desc(), "rule_no")
    active = recs.filter(F.col("is_active")) if "is_active" in recs.columns else recs
    return active.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def importance_ranked(importance: DataFrame, *, series: str = "series_id", top: int | None = None) -> DataFrame:
    """Rank by falling importance with the share of the largest one; a series has as many
    rows as the model has features."""
    w = Window.partitionBy(series)
    ranked = importance.withColumns({
        "rank": F.row_number().over(w.orderBy(F.col("mean_abs_shap").desc(), "feature")),
        "normalised": F.round(F.try_divide(F.col("mean_abs_shap") * 100, F.max("mean_abs_shap").over(w)), 1),
    })
    return ranked if top is None else ranked.filter(F.col("rank") <= top)
