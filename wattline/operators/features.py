"""Calendar, lag and rolling features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.config import DEFAULTS, Config
from wattline.functions.calendar import CALENDAR_COLUMNS, calendar_columns
from wattline.operators.ordering import drop_halo, halo_chunks

DIFF_LAGS = (1, 24, 168)


def add_calendar(df: DataFrame, *, ts: str = "ts", holidays: bool = True, country: str = "DE") -> DataFrame:
    """Calendar parts, season, weekend and holiday flags, cyclical encodings."""
    return df.withColumns(calendar_columns(F.col(ts), holidays=holidays, country=country))


def lag_columns(target: str, lags: Sequence[int], w, *, prefix: str) -> dict:
    return {f"{prefix}_t_{k}": F.lag(target, k).over(w) for k in lags}


def rolling_columns(target: str, windows: Sequence[int], w, *, prefix: str = "") -> dict:
    """Mean and sample deviation of the ``n`` rows before the current one."""
    out = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        out[f"{prefix}rolling_mean_{n}"] = F.avg(target).over(frame)
        out[f"{prefix}rolling_std_{n}"] = F.stddev_samp(target).over(frame)
    return out


def windowed(df, series, ts, before, build, plan, chunk_rows) -> DataFrame:
    """Columns of ``build(window)`` over rows that look back at most ``before`` rows."""
    extra = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    base, part = halo_chunks(df, [series], [ts], before=before, plan=plan, **extra)
    w = Window.partitionBy(*part).orderBy(ts)
    return drop_halo(base.withColumns(build(w)))


def add_lags(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", target: str = "y",
    exog: Sequence[str] = (), lags: Sequence[int] = DEFAULTS.lags, diffs: bool = True,
    plan: str = "auto", chunk_rows: int | None = None,
) -> DataFrame:
    """Row-offset lags of the target and of each exogenous column, and momentum diffs."""
    lags = sorted(set(lags))

    def build(w):
        cols = lag_columns(target, lags, w, prefix="load")
        for c in exog:
            cols.update(lag_columns(c, lags, w, prefix=c))
        return cols

    out = windowed(df, series, ts, max(lags), build, plan, chunk_rows)
    return out.withColumns(_diffs(lags)) if diffs else out


def _diffs(lags: Sequence[int]) -> dict:
    return {
        f"load_diff_{k}": F.col(f"load_t_{k}") - F.col(f"load_t_{k + 1}")
        for k in DIFF_LAGS if k in lags and k + 1 in lags
    }


def add_rolling(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", target: str = "y",
    exog: Sequence[str] = (), windows: Sequence[int] = DEFAULTS.windows,
    plan: str = "auto", chunk_rows: int | None = None,
) -> DataFrame:
    windows = sorted(set(windows))

    def build(w):
        cols = rolling_columns(target, windows, w)
        for c in exog:
            cols.update(rolling_columns(c, windows, w, prefix=f"{c}_"))
        return cols

    return windowed(df, series, ts, max(windows), build, plan, chunk_rows)


def transform(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", target: str = "y",
    exog: Sequence[str] = (), keep: Sequence[str] = (), cfg: Config = DEFAULTS, holidays: bool = True,
    drop_incomplete: bool = True, plan: str = "auto", chunk_rows: int | None = None,
) -> DataFrame:
    """All features in one pass: every lag and frame shares one window sort, and rows
    with any null are dropped at the end. ``keep`` names columns to carry along unchanged."""
    lags, windows = sorted(set(cfg.lags)), sorted(set(cfg.windows))

    def build(w):
        cols = lag_columns(target, lags, w, prefix="load")
        for c in exog:
            cols.update(lag_columns(c, lags, w, prefix=c))
        cols.update(rolling_columns(target, windows, w))
        for c in exog:
            cols.update(rolling_columns(c, windows, w, prefix=f"{c}_"))
        return cols

    out = windowed(df, series, ts, max(*lags, *windows), build, plan, chunk_rows)
    out = out.withColumns({**calendar_columns(F.col(ts), holidays=holidays, country=cfg.holiday_country), **_diffs(lags)})
    out = out.select(series, ts, target, *keep, *feature_names(exog, cfg))
    # calendar columns are never null, so only the others need checking
    nullable = [target, *[c for c in feature_names(exog, cfg) if c not in CALENDAR_COLUMNS]]
    return out.na.drop("any", subset=nullable) if drop_incomplete else out


def _exog_features(exog: Sequence[str], cfg: Config) -> list[str]:
    lags, windows = sorted(set(cfg.lags)), sorted(set(cfg.windows))
    names = [f"{c}_t_{k}" for c in exog for k in lags]
    return names + [f"{c}_rolling_{s}_{n}" for c in exog for n in windows for s in ("mean", "std")]


def feature_names(exog: Sequence[str] = (), cfg: Config = DEFAULTS) -> list[str]:
    """Feature columns in a fixed order: calendar, lags, diffs, rolling, then exogenous."""
    lags, windows = sorted(set(cfg.lags)), sorted(set(cfg.windows))
    own = [f"load_t_{k}" for k in lags]
    own += [f"load_diff_{k}" for k in DIFF_LAGS if k in lags and k + 1 in lags]
    own += [f"rolling_{s}_{n}" for n in windows for s in ("mean", "std")]
    return [*CALENDAR_COLUMNS, *own, *exog, *_exog_features(exog, cfg)]


def feature_columns(df: DataFrame, *, series: str = "series_id", ts: str = "ts", target: str = "y") -> list[str]:
    """Every column but the keys and the target, so raw exogenous columns count too."""
    return [c for c in df.columns if c not in (series, ts, target)]


def fill_missing_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model input order; features the caller did not send become 0.0."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(c) if c in have else F.lit(0.0)).alias(c) for c in names])
