"""Future index, exogenous projection, recursive forecasts, bands and what-if."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.config import DEFAULTS, Config
from wattline.functions.calendar import CALENDAR_COLUMNS, calendar_columns, epoch_us
from wattline.operators import features
from wattline.operators.ordering import positions, tail

HOUR_US = 3_600_000_000
LOWER_FACTOR, UPPER_FACTOR = 0.90, 1.10
# Series that one task forecasts together.
PANEL_SERIES = 64


def infer_frequency(df: DataFrame, *, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """One row per series: last time and step in microseconds. The step is the common gap
    of the last ten rows, or one hour when they are irregular or fewer than three."""
    last = tail(df.select(series, ts), 10, series=series, ts=ts)
    w = Window.partitionBy(series).orderBy(ts)
    gaps = last.withColumn("_gap", epoch_us(ts) - F.lag(epoch_us(ts)).over(w))
    regular = (F.count(F.lit(1)) >= 3) & (F.min("_gap") == F.max("_gap")) & (F.min("_gap") > 0)
    return gaps.groupBy(series).agg(
        F.max(ts).alias("last_ts"), F.when(regular, F.min("_gap")).otherwise(F.lit(HOUR_US)).alias("freq_us")
    )


def future_index(df: DataFrame, horizon: int, *, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """``horizon`` future timestamps per series with their step number."""
    kind = dict(df.dtypes)[ts]
    freq = infer_frequency(df, series=series, ts=ts)
    steps = freq.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    at = F.timestamp_micros(epoch_us("last_ts") + F.col("step") * F.col("freq_us")).cast(kind)
    return steps.select(series, "step", at.alias(ts))


def exog_profile(df: DataFrame, exog: Sequence[str], *, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Mean of each exogenous column by weekday and hour: at most 168 rows per series."""
    return df.groupBy(series, F.weekday(ts).alias("dow"), F.hour(ts).alias("hour")).agg(
        *[F.avg(c).alias(c) for c in exog]
    )


def future_exog(
    df: DataFrame, horizon: int, exog: Sequence[str], *, series: str = "series_id", ts: str = "ts"
) -> DataFrame:
    """Future index with exogenous values from the profile, else the last known value."""
    future = future_index(df, horizon, series=series, ts=ts)
    if not exog:
        return future
    profile = exog_profile(df, exog, series=series, ts=ts)
    last = df.groupBy(series).agg(*[F.max_by(c, ts).alias(f"_last_{c}") for c in exog])
    keyed = future.withColumns({"dow": F.weekday(ts), "hour": F.hour(ts)})
    joined = keyed.join(profile, [series, "dow", "hour"], "left").join(last, series, "left")
    return joined.select(series, "step", ts, *[F.coalesce(c, f"_last_{c}").alias(c) for c in exog])


def with_bands(df: DataFrame, *, value: str = "forecast") -> DataFrame:
    """Fixed-factor bounds around the forecast (not a statistical interval)."""
    return df.withColumns({
        "lower_bound": F.col(value) * F.lit(LOWER_FACTOR), "upper_bound": F.col(value) * F.lit(UPPER_FACTOR)
    })


def cut_horizons(
    points: DataFrame, horizons: dict[str, int] = DEFAULTS.horizons, *, step: str = "step"
) -> DataFrame:
    """One long forecast cut into labelled horizons; each is a prefix of the longest."""
    labels = F.array(*[F.when(F.col(step) <= n, F.lit(h)) for h, n in horizons.items()])
    return points.withColumn("horizon", F.explode(F.array_compact(labels)))


def recursive_forecast(
    history: DataFrame, model, horizon: int, *, exog: Sequence[str] = (), series: str = "series_id",
    ts: str = "ts", target: str = "y", cfg: Config = DEFAULTS, one_step_late: bool = False,
) -> DataFrame:
    """One-step forecasts fed back as lags, ``horizon`` steps per series.

    Calendar and exogenous features of the future rows come from Spark. Only what depends
    on earlier predictions (target lags, diffs, rolling values) is kept up in the
    grouped function. It sees a panel of up to ``PANEL_SERIES`` series with at most ``reach`` history rows each, and asks the
    model once per step for all of them. ``model`` supplies ``panel_scorer()`` and optional per-series parameters.

    ``one_step_late`` takes the features of the previous timestamp for every step.
    """
    reach = max(*cfg.lags, *cfg.windows) + 31
    exog = list(exog)
    past = tail(history.select(series, ts, target, *exog), reach, series=series, ts=ts)
    past = past.withColumn("step", F.lit(0))
    coming = future_exog(history, horizon, exog, series=series, ts=ts).withColumn(target, F.lit(None).cast("double"))
    frame = past.unionByName(coming).withColumns(calendar_columns(F.col(ts), country=cfg.holiday_country))
    if exog:
        lags, windows = sorted(set(cfg.lags)), sorted(set(cfg.windows))
        w = Window.partitionBy(series).orderBy(ts)  # at most reach + horizon rows
        cols: dict[str, Column] = {}
        for c in exog:
            cols.update(features.lag_columns(c, lags, w, prefix=c))
            cols.update(features.rolling_columns(c, windows, w, prefix=f"{c}_"))
        frame = frame.withColumns(cols)
    names = features.feature_names(exog, cfg)
    given = [c for c in names if c in CALENDAR_COLUMNS or c in frame.columns]
    state, prepare = LagState(names, cfg), model.panel_scorer()
    slots = [names.index(c) for c in given]
    schema = T.StructType([
        T.StructField(series, T.StringType()), T.StructField("step", T.IntegerType()),
        history.schema[ts], T.StructField("forecast", T.DoubleType()),
    ])

    def run(pdf: pd.DataFrame, own: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values([series, ts], kind="stable").reset_index(drop=True)
        if own is not None:
            pdf = pdf[pdf[series].isin(own["_series"])].reset_index(drop=True)
        if not len(pdf):
            return pd.DataFrame({series: [], "step": [], ts: pdf[ts], "forecast": []})
        starts = np.flatnonzero(pdf[series].ne(pdf[series].shift()).to_numpy())
        sizes = np.diff([*starts, len(pdf)])
        coming = pdf["step"].to_numpy() > 0
        steps = int(np.add.reduceat(coming, starts).max())
        # rows of a panel end together: history up to column ``reach``, then the steps
        column = np.arange(len(pdf)) - np.repeat(starts + sizes, sizes) + reach + steps
        place = np.repeat(np.arange(len(starts)), sizes), column
        y = np.full((len(starts), reach + steps), np.nan)
        y[place] = pdf[target].to_numpy(dtype=float)
        fixed = np.full((*y.shape, len(given)), np.nan)
        fixed[place] = pdf[given].to_numpy(dtype=float)
        first = reach + steps - sizes
        score = prepare(None if own is None else own.set_index("_series").loc[pdf[series].to_numpy()[starts]].reset_index())
        finite = np.isfinite(y[:, :reach])
        newest = reach - 1 - finite[:, ::-1].argmax(axis=1)
        last = np.where(finite.any(axis=1), y[np.arange(len(y)), newest], 0.0)
        for i in range(reach, reach + steps):
            at = i - 1 if one_step_late else i
            x = state.panel(y, at, first)
            x[:, slots] = fixed[:, at]
            whole = np.isfinite(x).all(axis=1)
            pred = np.where(whole, score(np.where(whole[:, None], x, 0.0)), np.nan)
            y[:, i] = last = np.where(np.isfinite(pred), np.maximum(pred, 0.0), last)
        out = pdf.loc[coming, [series, "step", ts]].copy()
        out["forecast"] = y[place][coming]
        return out

    panels = -(-max(1, past.select(series).distinct().count()) // PANEL_SERIES)
    panel = F.pmod(F.xxhash64(series), F.lit(panels)).alias("_panel")
    grouped = frame.select("*", panel).groupBy("_panel")
    params = model.parameters()
    if params is None:
        return grouped.applyInPandas(lambda pdf: run(pdf.drop(columns="_panel"), None), schema)
    own = params.select(panel, F.col(series).alias("_series"), *[c for c in params.columns if c != series])
    return grouped.cogroup(own.groupBy("_panel")).applyInPandas(lambda a, b: run(a, b), schema)


class LagState:
    """Target-dependent features of rows from the values before them."""

    def __init__(self, names: Sequence[str], cfg: Config = DEFAULTS) -> None:
        self.names = list(names)
        index = {n: i for i, n in enumerate(self.names)}
        self.lags = [(index[f"load_t_{k}"], k) for k in sorted(set(cfg.lags))]
        self.diffs = [(index[f"load_diff_{k}"], k) for k in features.DIFF_LAGS if f"load_diff_{k}" in index]
        self.windows = [(index[f"rolling_mean_{n}"], index[f"rolling_std_{n}"], n) for n in sorted(set(cfg.windows))]

    def panel(self, y: np.ndarray, i: int, first: np.ndarray) -> np.ndarray:
        """Features of column ``i`` of a panel (a row per series, whose values start at column ``first``)."""
        x = np.full((len(y), len(self.names)), np.nan)
        for slot, k in self.lags:
            if i >= k:
                x[:, slot] = y[:, i - k]
        for slot, k in self.diffs:
            if i >= k + 1:
                x[:, slot] = y[:, i - k] - y[:, i - k - 1]
        for mean, std, n in self.windows:
            own = np.arange(max(0, i - n), i) >= first[:, None]
            part, size = np.where(own, y[:, max(0, i - n):i], 0.0), own.sum(axis=1)
            center = part.sum(axis=1) / np.maximum(size, 1)
            spread = (np.where(own, part - center[:, None], 0.0) ** 2).sum(axis=1)
            x[:, mean] = np.where(size > 0, center, np.nan)
            x[:, std] = np.where(size > 1, np.sqrt(spread / np.maximum(size - 1, 1)), np.nan)
        return x


def forecast_horizons(
    history: DataFrame, model, *, exog: Sequence[str] = (), cfg: Config = DEFAULTS, **kw
) -> DataFrame:
    """All horizons from one run of the longest: ``series, horizon, step, ts, forecast, bounds``.

    Statistical models forecast natively, the others recursively."""
    longest = max(cfg.horizons.values())
    if getattr(model, "statistical", False):
        points = model.forecast(history, longest, exog=exog)
    else:
        points = recursive_forecast(history, model, longest, exog=exog, cfg=cfg, **kw)
    return cut_horizons(with_bands(points), cfg.horizons)


def what_if(
    forecast: DataFrame, *, peak_shaving: float = 0.0, solar_shift: float = 0.0, grid_opt: float = 0.0,
    keys: Sequence[str] = ("series_id",), ts: str = "ts", max_points: int | None = None,
) -> DataFrame:
    """Simulated load: shave the excess over the mean, cut daylight load, cut all load (percent).

    Runs on every point; ``max_points`` first thins each key to chart resolution."""
    rows = forecast
    if max_points is not None:
        ranked = positions(rows, list(keys), [ts], pos="_i", total="_n")
        step = F.greatest(F.ceil(F.col("_n") / F.lit(max_points)), F.lit(1))
        rows = ranked.filter(F.col("_i") % step == 0).drop("_i", "_n")
    rows = rows.withColumn("base_load", F.round("forecast"))
    mean = rows.groupBy(*keys).agg(F.round(F.avg("base_load")).alias("_mean"))
    load, pct = F.col("base_load"), lambda v: F.lit(float(v) / 100.0)
    excess = F.when(load > F.col("_mean"), (load - F.col("_mean")) * pct(peak_shaving)).otherwise(0.0)
    solar = F.when(F.hour(ts).between(8, 18), load * pct(solar_shift)).otherwise(0.0)
    cut = load - excess - solar - load * pct(grid_opt)
    joined = rows.join(mean, list(keys))
    return joined.select(
        *keys, ts, "base_load", F.greatest(F.lit(0.0), F.round(cut)).alias("simulated_load")
    )


# Money and carbon per unit of load offset.
SAVINGS_PER_UNIT, CARBON_PER_UNIT = 85, 420


def what_if_totals(simulated: DataFrame, *, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    offset = F.sum(F.col("base_load") - F.col("simulated_load"))
    peak = F.greatest(F.lit(0.0), F.max("base_load") - F.max("simulated_load"))
    return simulated.groupBy(*keys).agg(
        offset.alias("total_offset"), peak.alias("peak_cut"),
        (offset * SAVINGS_PER_UNIT).alias("savings"), (offset * CARBON_PER_UNIT).alias("carbon"),
    )
