"""Rule-based recommendations: one small aggregate per series and rule, then literal rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.config import DEFAULTS, Config
from wattline.operators.ordering import choose_plan, quantiles
from wattline.operators.reports import implemented_only, safe_concat
from wattline.session import reliable

COLUMNS = [
    "series_id", "rule_no", "category", "priority", "title", "description", "estimated_saving_pct", "action_items"
]
DAY, WEEK = 24, 168
EPSILON = 1e-8

# Categories, texts and action lists of the rules. ``%s`` places take
# numbers formatted by the rule.
TEXTS = {
    "peak_shift": {
        "category": "Load Shifting",
        "title": "Shift Loads Away from Peak Hours (3 PM – 6 PM)",
        "description": "Forecasted peak consumption (%s MW) is %sx higher than off-peak (%s MW). "
                       "Shifting flexible loads reduces peak demand charges.",
        "actions": [
            "Schedule industrial batch jobs between 10 PM – 6 AM.",
            "Pre-cool or pre-heat buildings before 3 PM.",
            "Enable demand-response programs with grid operator.",
            "Install smart meters with time-of-use tariff plans.",
        ],
    },
    "offpeak_storage": {
        "category": "Energy Storage",
        "title": "Utilize Off-Peak Hours for Battery Charging",
        "description": "Night-time load (%s MW) is %s%% below daily average. "
                       "Charge storage systems during off-peak for daytime discharge.",
        "actions": [
            "Install grid-scale battery storage.",
            "Configure EV fleet charging for 12 AM – 5 AM window.",
            "Enable automated smart charging algorithms.",
        ],
    },
    "week_trend": {
        "category": "Consumption Monitoring",
        "title": "Consumption Increased %s%% Week-over-Week",
        "description": "Last week average: %s MW vs previous week: %s MW. Investigate root cause immediately.",
        "actions": [
            "Audit new high-consumption equipment activated last week.",
            "Check HVAC set-points for unintended changes.",
            "Review occupancy patterns and scheduling.",
        ],
    },
    "top_decile": {
        "category": "Peak Reduction",
        "title": "Current Consumption in Top 10% of Historical Range",
        "description": "Recent 24-hour average (%s MW) exceeds the %sth percentile (%s MW).",
        "actions": [
            "Activate demand curtailment programs.",
            "Reduce non-critical system loads temporarily.",
            "Alert facility managers for immediate action.",
        ],
    },
    "weekend_gap": {
        "category": "Scheduling",
        "title": "Weekend Load is 40%+ Lower — Optimize Scheduled Maintenance",
        "description": "Weekday avg: %s MW | Weekend avg: %s MW. "
                       "Schedule high-energy maintenance tasks on weekends.",
        "actions": [
            "Move planned maintenance windows to Saturday/Sunday.",
            "Schedule data center backups and batch jobs for weekends.",
        ],
    },
    "anomaly_rate": {
        "category": "Anomaly Management",
        "title": "%s Anomalous Consumption Events Detected (%s%%)",
        "description": "Anomalous readings may indicate equipment malfunction, "
                       "data quality issues, or unauthorized energy use.",
        "actions": [
            "Investigate timestamps flagged as anomalous.",
            "Check sensor calibration and data pipelines.",
            "Verify no unauthorized high-draw equipment is connected.",
            "Install power quality monitoring systems.",
        ],
    },
    "driver_rolling": {
        "category": "Forecasting",
        "title": "Historical Rolling Averages Strongly Drive Predictions",
        "description": "Rolling mean features are top SHAP contributors, "
                       "indicating strong autocorrelation. Consider ARIMA-based approaches.",
        "actions": [
            "Leverage rolling forecast models for operational planning.",
            "Build automated alerts when rolling average deviates significantly.",
        ],
    },
    "driver_hour": {
        "category": "Time-of-Use",
        "title": "Hour-of-Day is a Key Driver — Implement Time-of-Use Tariffs",
        "description": "Hour features rank highly in SHAP importance, "
                       "indicating strong intraday patterns suitable for TOU pricing.",
        "actions": [
            "Negotiate time-of-use tariff with utility provider.",
            "Automate energy-intensive processes to run in cheapest hours.",
            "Display real-time pricing to building occupants.",
        ],
    },
    "driver_calendar": {
        "category": "Calendar Optimization",
        "title": "Calendar Effects Are Significant — Plan Accordingly",
        "description": "Holiday and weekend flags are strong predictors. "
                       "Pre-positioning resources around calendar events reduces waste.",
        "actions": [
            "Pre-schedule HVAC setbacks before holidays.",
            "Coordinate production shutdowns with public holidays.",
        ],
    },
    "general_hvac": {
        "category": "HVAC Optimization",
        "title": "HVAC Systems: Implement Smart Scheduling",
        "description": "HVAC typically accounts for 30–50% of commercial building energy. "
                       "Smart scheduling and setbacks can deliver significant savings.",
        "actions": [
            "Install programmable thermostats with occupancy sensors.",
            "Set heating/cooling setbacks during unoccupied hours.",
            "Schedule preventive HVAC maintenance quarterly.",
            "Consider variable frequency drives (VFDs) for HVAC motors.",
        ],
    },
    "general_renewable": {
        "category": "Renewable Integration",
        "title": "Increase Renewable Energy Consumption During Solar/Wind Peaks",
        "description": "Grid data shows significant solar and wind generation. "
                       "Aligning high-consumption tasks with renewable peaks reduces carbon footprint.",
        "actions": [
            "Monitor real-time renewable generation API.",
            "Shift flexible loads to coincide with high solar/wind output.",
            "Consider on-site renewable generation (rooftop solar / wind).",
        ],
    },
}


def _whole(c: Column) -> Column:
    return F.format_number(c, 0)


def _text(template: str, *args: Column) -> Column:
    return F.format_string(template, *args) if args else F.lit(template)


def _rows(
    fired: DataFrame, rule: str, no: int, priority: Column | str, saving: Column | float, *,
    title: Sequence[Column] = (), description: Sequence[Column] = (), series: str = "series_id",
) -> DataFrame:
    text = TEXTS[rule]
    return fired.select(
        F.col(series), F.lit(no).alias("rule_no"), F.lit(text["category"]).alias("category"),
        (F.lit(priority) if isinstance(priority, str) else priority).alias("priority"),
        _text(text["title"], *title).alias("title"),
        _text(text["description"], *description).alias("description"),
        (saving if isinstance(saving, Column) else F.lit(float(saving))).cast("double").alias("estimated_saving_pct"),
        F.array(*[F.lit(a) for a in text["actions"]]).alias("action_items"),
    )


def forecast_profile(forecast: DataFrame, *, ts: str = "ts", cfg: Config = DEFAULTS) -> DataFrame:
    """One pass over a forecast: peak, off-peak, night and overall means per series."""
    hour, load = F.hour(ts), F.col("forecast")
    peak = hour.isin(list(cfg.peak_hours))
    return forecast.groupBy("series_id").agg(
        F.coalesce(F.avg(F.when(peak, load)), F.lit(0.0)).alias("peak_mean"),
        F.coalesce(F.avg(F.when(~peak, load)), F.lit(0.0)).alias("offpeak_mean"),
        F.avg(F.when(hour.between(0, 5), load)).alias("night_mean"), F.avg(load).alias("mean"),
    )


def peak_shift(profile: DataFrame, *, cfg: Config = DEFAULTS, min_ratio: float = 1.15) -> DataFrame:
    """Mean peak-hour forecast over the threshold and over ``min_ratio`` times off-peak."""
    peak, off = F.col("peak_mean"), F.col("offpeak_mean")
    fired = profile.filter((peak > cfg.load_shift_threshold) & (off > 0)).withColumn("ratio", peak / off)
    fired = fired.filter(F.col("ratio") > min_ratio)
    return _rows(
        fired, "peak_shift", 1, "HIGH", F.least(F.lit(15.0), (F.col("ratio") - 1) * 10),
        description=[_whole(peak), F.format_string("%.1f", "ratio"), _whole(off)],
    )


def offpeak_storage(profile: DataFrame, *, share: float = 0.75) -> DataFrame:
    """Night mean (hours 0 to 5) under ``share`` of the overall mean."""
    night, mean = F.col("night_mean"), F.col("mean")
    below = F.format_string("%.0f", F.lit(100.0) * (1 - night / mean))
    return _rows(
        profile.filter(night < mean * share), "offpeak_storage", 2, "MEDIUM", 8.0, description=[_whole(night), below]
    )


def history_profile(
    history: DataFrame, *, ts: str = "ts", target: str = "y", cfg: Config = DEFAULTS, plan: str = "auto"
) -> DataFrame:
    """One row per series for the history rules: totals, weekday and weekend means and the
    high percentile from one aggregate, recent means from the newest two weeks of rows."""
    known = history.filter(F.col(target).isNotNull()).select("series_id", ts, target)
    plan = choose_plan(known, ["series_id"], plan)
    y, weekend = F.col(target), F.weekday(ts) >= 5
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.avg(F.when(~weekend, y)).alias("weekday_mean"),
        F.avg(F.when(weekend, y)).alias("weekend_mean"),
    ]
    if plan == "plain":
        totals = known.groupBy("series_id").agg(*aggs, F.percentile(y, F.lit(cfg.high_percentile)).alias("high"))
    else:
        high = quantiles(known, target, {"high": cfg.high_percentile}, plan=plan)
        totals = known.groupBy("series_id").agg(*aggs).join(high, "series_id")
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col(ts).desc()))
    recent = known.withColumn("rn", rank).filter(F.col("rn") <= 2 * WEEK).groupBy("series_id").agg(
        F.avg(F.when(F.col("rn") <= DAY, y)).alias("last_day"), F.avg(F.when(F.col("rn") <= WEEK, y)).alias("last_week"),
        F.avg(F.when(F.col("rn") > WEEK, y)).alias("week_before"),
    )
    return totals.join(recent, "series_id")


def week_trend(profile: DataFrame, *, min_change: float = 10.0) -> DataFrame:
    """Mean of the last 168 values against the 168 before (or the whole series if shorter)."""
    last = F.col("last_week")
    before = F.when(F.col("n") >= 2 * WEEK, F.col("week_before")).otherwise(F.col("mean"))
    fired = profile.filter(F.col("n") >= WEEK).withColumn("before", before)
    fired = fired.withColumn("change", (last - F.col("before")) / (F.col("before") + EPSILON) * 100)
    return _rows(
        fired.filter(F.col("change") > min_change), "week_trend", 3, "HIGH", F.col("change") * 0.5,
        title=[F.format_string("%.1f", "change")], description=[_whole(last), _whole(F.col("before"))],
    )


def top_decile(profile: DataFrame, *, cfg: Config = DEFAULTS) -> DataFrame:
    """Mean of the last 24 values over the high percentile, for series of 168 or more."""
    recent, high = F.col("last_day"), F.col("high")
    percentile = F.lit(f"{cfg.high_percentile * 100:.1f}")
    return _rows(
        profile.filter((F.col("n") >= WEEK) & (recent > high)), "top_decile", 4, "HIGH", 12.0,
        description=[_whole(recent), percentile, _whole(high)],
    )


def weekend_gap(profile: DataFrame, *, share: float = 0.6) -> DataFrame:
    """Weekend mean under ``share`` of the weekday mean."""
    week, end = F.col("weekday_mean"), F.col("weekend_mean")
    fired = profile.filter((week > 0) & (F.try_divide(end, week) < share))
    return _rows(fired, "weekend_gap", 5, "LOW", 5.0, description=[_whole(week), _whole(end)])


def anomaly_share(flagged: DataFrame, *, threshold: float = 5.0, high: float = 10.0) -> DataFrame:
    agg = flagged.groupBy("series_id").agg(
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    fired = agg.withColumn("pct", F.col("hits") * 100 / (F.col("n") + EPSILON)).filter(F.col("pct") > threshold)
    return _rows(
        fired, "anomaly_rate", 6, F.when(F.col("pct") > high, "HIGH").otherwise("MEDIUM"),
        F.least(F.lit(20.0), F.col("pct")), title=[F.col("hits").cast("string"), F.format_string("%.1f", "pct")],
    )


def driver_rules(importance: DataFrame, *, top: int = 5) -> DataFrame:
    """Rules on the five most important features of each series."""
    w = Window.partitionBy("series_id").orderBy(F.col("mean_abs_shap").desc(), "feature")
    best = importance.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    feature = F.col("feature")
    agg = best.groupBy("series_id").agg(
        F.max(feature.contains("rolling")).alias("rolling"), F.max(feature.contains("hour")).alias("hour"),
        F.max(feature.contains("is_holiday") | feature.contains("is_weekend")).alias("calendar"),
    )
    return safe_concat([
        _rows(agg.filter("rolling"), "driver_rolling", 7, "LOW", 0.0),
        _rows(agg.filter("hour"), "driver_hour", 8, "MEDIUM", 7.0),
        _rows(agg.filter("calendar"), "driver_calendar", 9, "LOW", 4.0),
    ])


def general_rules(series: DataFrame) -> DataFrame:
    """The two rules that always hold, for each distinct series."""
    ids = series.select("series_id").distinct()
    return safe_concat([
        _rows(ids, "general_hvac", 10, "MEDIUM", 15.0), _rows(ids, "general_renewable", 11, "MEDIUM", 10.0)
    ])


def deduplicate(recs: DataFrame) -> DataFrame:
    """First of every title per series; a series has at most a dozen rows."""
    w = Window.partitionBy("series_id", "title").orderBy("rule_no")
    return recs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def priority_order(priority: str = "priority") -> Column:
    return F.when(F.col(priority) == "HIGH", 0).when(F.col(priority) == "MEDIUM", 1).otherwise(2)


def generate(
    forecast: DataFrame | None = None, history: DataFrame | None = None, anomalies: DataFrame | None = None,
    importance: DataFrame | None = None, *, cfg: Config = DEFAULTS, plan: str = "auto",
) -> DataFrame:
    """All rules whose inputs are given, deduplicated by title, with ``position`` in
    priority order (stable by rule) inside each series.

    The profiles have one row per series and feed several rules, so they are written once."""
    parts, sources = [], []
    if forecast is not None:
        profile = reliable(forecast_profile(forecast, cfg=cfg))
        parts += [peak_shift(profile, cfg=cfg), offpeak_storage(profile)]
        sources.append(forecast)
    if history is not None:
        profile = reliable(history_profile(history, cfg=cfg, plan=plan))
        parts += [week_trend(profile), top_decile(profile, cfg=cfg), weekend_gap(profile)]
        sources.append(history)
    if anomalies is not None:
        parts.append(anomaly_share(anomalies))
        sources.append(anomalies)
    if importance is not None:
        parts.append(driver_rules(importance))
        sources.append(importance)
    if not sources:
        raise ValueError("give at least one input frame to know the series")
    parts.append(general_rules(safe_concat([s.select("series_id").distinct() for s in sources])))
    recs = deduplicate(safe_concat([p.select(*COLUMNS) for p in parts]))
    w = Window.partitionBy("series_id").orderBy(priority_order(), "rule_no")
    return recs.withColumn("position", F.row_number().over(w))


def to_records(recs: DataFrame) -> DataFrame:
    """The six public fields as a JSON text per recommendation."""
    fields = ["category", "priority", "title", "description", "estimated_saving_pct", "action_items"]
    return recs.select("series_id", "position", F.to_json(F.struct(*fields)).alias("record"))


# Daily baseline in kWh, kg CO2 per kWh, money per kWh.
BASELINE_KWH, CARBON_FACTOR, PRICE_PER_KWH = 50_000, 0.4, 0.12


def savings(recs: DataFrame) -> DataFrame:
    """Energy and carbon estimate per recommendation."""
    kwh = F.col("estimated_saving_pct") / 100 * BASELINE_KWH
    return recs.withColumns({"kwh": kwh, "co2": kwh * CARBON_FACTOR})


def savings_totals(recs: DataFrame, implemented: DataFrame, *, key: str = "title") -> DataFrame:
    """Portfolio means and totals, and what the implemented ones realise, per series."""
    done = implemented_only(recs, implemented, key=key).select("series_id", "rule_no", F.lit(True).alias("_done"))
    rows = savings(recs).join(done, ["series_id", "rule_no"], "left")
    realised = F.coalesce(F.sum(F.when(F.col("_done"), F.col("kwh"))), F.lit(0.0))
    n = F.count(F.lit(1))
    return rows.groupBy("series_id").agg(
        n.alias("recommendations"), F.avg("estimated_saving_pct").alias("mean_saving_pct"), F.sum("co2").alias("total_co2"),
        realised.alias("realised_kwh"), (realised * CARBON_FACTOR).alias("realised_co2"),
        (realised * PRICE_PER_KWH).alias("realised_money"),
        F.round(F.count("_done") * 100 / n).cast("long").alias("implemented_pct"),
    )
