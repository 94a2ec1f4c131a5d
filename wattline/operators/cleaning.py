"""Deduplication, gap filling and outlier capping."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattline.config import DEFAULTS, Config
from wattline.functions.calendar import epoch_us
from wattline.operators.ordering import choose_plan, drop_halo, halo_chunks, quantiles
from wattline.session import reliable

log = logging.getLogger(__name__)


def dedup_first(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", ingest_order: str | None = None
) -> DataFrame:
    """Keep the first row of every (series, ts) by ``ingest_order``.

    An aggregate rather than a window: copies are combined on the map side, so a
    timestamp repeated many times is not one big task. ``ingest_order`` must be unique among
    copies, unless it is a struct, as the sources give it: rows without one come last, and content decides ties. Without an order
    the smallest content wins, column by column from the left, with nulls last, so a null never beats a value."""
    rest = [c for c in df.columns if c not in (series, ts)]
    if not rest:
        return df.dropDuplicates([series, ts])
    if len(rest) > 1 and (not ingest_order or isinstance(df.schema[ingest_order].dataType, StructType)):
        # The least struct takes a sort in every task before rows are combined, so tasks get Spark's advisory size, not a share of the table.
        df = df.withColumn("_spread", F.xxhash64(*df.columns)).hint("rebalance", "_spread").drop("_spread")
    if ingest_order and isinstance(df.schema[ingest_order].dataType, StructType):
        content = [c for name in rest if name != ingest_order for c in (F.col(name).isNull().alias(f"_null_{name}"), F.col(name))]
        first = F.min(F.struct(F.col(ingest_order).isNull().alias("_unplaced"), ingest_order, *content))
        kept = df.groupBy(series, ts).agg(first.alias("_row"))
        return kept.select(*[F.col(c) if c in (series, ts) else F.col(f"_row.{c}").alias(c) for c in df.columns])
    if ingest_order:
        # Per column, so that fixed-width rows stay in a hash aggregate without sorting.
        rest_cols = [F.min_by(c, ingest_order).alias(c) for c in rest if c != ingest_order]
        return df.groupBy(series, ts).agg(*rest_cols, F.min(ingest_order).alias(ingest_order)).select(*df.columns)
    if len(rest) == 1:
        return df.groupBy(series, ts).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)
    content = [c for name in rest for c in (F.col(name).isNull().alias(f"_null_{name}"), F.col(name))]
    kept = df.groupBy(series, ts).agg(F.min(F.struct(*content)).alias("_row"))
    return kept.select(*[F.col(c) if c in (series, ts) else F.col(f"_row.{c}").alias(c) for c in df.columns])


def with_neighbours(
    df: DataFrame,
    cols: Sequence[str],
    *,
    series: str = "series_id",
    ts: str = "ts",
    limit: int = 6,
    plan: str = "auto",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``_prev_<c>`` and ``_next_<c>``: the nearest valid rows at or before and at or
    after each row, as ``struct(t, v, t_limit)`` with ``t_limit`` the time ``limit`` rows on.

    Both come from a running ``last`` (one ascending, one descending sort). A frame of
    current row to unbounded following would be quadratic in the series length."""
    plan = choose_plan(df, [series], plan)
    extra = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    base = df.withColumn("_t", epoch_us(ts))
    base, part = halo_chunks(base, [series], [ts], after=limit, plan=plan, **extra)
    w = Window.partitionBy(*part)
    base = base.withColumn("_t_limit", F.lead("_t", limit).over(w.orderBy("_t")))
    if plan == "chunked":
        # Chunk number kept as a plain column: the halo rows have served the look-ahead.
        base = drop_halo(base.withColumn("_block", F.col("_chunk")))
        part = [series, "_block"]
        w = Window.partitionBy(*part)
    point = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(c).cast("double").alias("v"), F.col("_t_limit").alias("t_limit")))
        for c in cols
    }
    up = w.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.col("_t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumns({f"_prev_{c}": F.last(p, ignorenulls=True).over(up) for c, p in point.items()})
    out = out.withColumns({f"_next_{c}": F.last(p, ignorenulls=True).over(down) for c, p in point.items()})
    if plan == "chunked":
        # What lies before and after a chunk: one row per chunk, so a short window.
        edges = base.groupBy(*part).agg(
            # Rows whose ordering value is null are ignored, so only valid points count.
            *[F.max_by(p, p["t"]).alias(f"_last_{c}") for c, p in point.items()],
            *[F.min_by(p, p["t"]).alias(f"_first_{c}") for c, p in point.items()],
        )
        ew = Window.partitionBy(series)
        before = ew.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        behind = ew.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(
            *part,
            *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_cp_{c}") for c in cols],
            *[F.last(f"_first_{c}", ignorenulls=True).over(behind).alias(f"_cn_{c}") for c in cols],
        )
        out = out.join(edges, part)
        out = out.withColumns({
            **{f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_cp_{c}") for c in cols},
            **{f"_next_{c}": F.coalesce(f"_next_{c}", f"_cn_{c}") for c in cols},
        })
    keep = [*df.columns, "_t", *[f"_{s}_{c}" for c in cols for s in ("prev", "next")]]
    return out.select(*keep)


def _fill_columns(df: DataFrame, cols, series, ts) -> list[str]:
    if cols is not None:
        return list(cols)
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [c for c, t in df.dtypes if c not in (series, ts) and (t in numeric or t.startswith("decimal"))]


def fill_missing(
    df: DataFrame,
    strategy: str = "interpolate",
    *,
    series: str = "series_id",
    ts: str = "ts",
    target: str = "y",
    cols: Sequence[str] | None = None,
    limit: int = 6,
    plan: str = "auto",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Fill nulls in all numeric columns (or ``cols``).

    interpolate  linear in time for the first ``limit`` rows of a gap, later rows repeat the
                 last interpolated value, a trailing gap repeats the last valid value
                 and a leading gap takes the first valid one
    ffill        previous valid value, else the next one
    bfill        next valid value, else the previous one
    drop         remove rows with a null target
    """
    strategy = strategy.lower()
    if strategy == "drop":
        return df.na.drop(subset=[target])
    if strategy not in ("interpolate", "ffill", "bfill"):
        log.warning("unknown missing strategy %r; using interpolate", strategy)
        strategy = "interpolate"
    cols = _fill_columns(df, cols, series, ts)
    if not cols:
        return df
    out = with_neighbours(df, cols, series=series, ts=ts, limit=limit, plan=plan, chunk_rows=chunk_rows)

    def filled(c: str):
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        if strategy == "ffill":
            return F.coalesce(F.col(c), prev["v"], nxt["v"])
        if strategy == "bfill":
            return F.coalesce(F.col(c), nxt["v"], prev["v"])
        at = F.least(F.col("_t"), prev["t_limit"])
        slope = (nxt["v"] - prev["v"]) / (nxt["t"] - prev["t"])
        inner = F.when(prev.isNotNull() & nxt.isNotNull() & (nxt["t"] > prev["t"]), prev["v"] + slope * (at - prev["t"]))
        return F.coalesce(F.col(c), inner, prev["v"], nxt["v"])

    return out.select(*[filled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_null_target(df: DataFrame, *, target: str = "y") -> DataFrame:
    return df.na.drop(subset=[target])


def iqr_bounds(
    df: DataFrame, *, series: str = "series_id", target: str = "y", k: float = 1.5, plan: str = "auto"
) -> DataFrame:
    """One row per series: quartiles and the fences ``k`` interquartile ranges out."""
    q = quantiles(df, target, {"q1": 0.25, "q3": 0.75}, keys=[series], plan=plan)
    spread = (F.col("q3") - F.col("q1")) * F.lit(k)
    return q.withColumns({"lower": F.col("q1") - spread, "upper": F.col("q3") + spread})


def z_bounds(df: DataFrame, *, series: str = "series_id", target: str = "y", threshold: float = 3.0) -> DataFrame:
    """One row per series: mean -/+ ``threshold`` sample standard deviations."""
    stats = df.groupBy(series).agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("sd"))
    spread = F.col("sd") * F.lit(threshold)
    return stats.withColumns({"lower": F.col("mean") - spread, "upper": F.col("mean") + spread})


def bounds(df: DataFrame, method: str, *, series="series_id", target="y", cfg: Config = DEFAULTS, plan="auto") -> DataFrame:
    if method == "iqr":
        out = iqr_bounds(df, series=series, target=target, k=cfg.iqr_multiplier, plan=plan)
    elif method == "zscore":
        out = z_bounds(df, series=series, target=target, threshold=cfg.outlier_threshold)
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return out.select(series, "lower", "upper")


def outlier_counts(
    df: DataFrame, *, series: str = "series_id", target: str = "y", k: float = 1.5,
    threshold: float = 3.0, plan: str = "auto",
) -> DataFrame:
    """Rows strictly outside the fences, and rows over the population z threshold."""
    limits = iqr_bounds(df, series=series, target=target, k=k, plan=plan).select(series, "lower", "upper")
    moments = df.groupBy(series).agg(F.avg(target).alias("_m"), F.stddev_pop(target).alias("_s"))
    joined = df.join(limits.join(moments, series), series, "left")
    y = F.col(target)
    return joined.groupBy(series).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((y < F.col("lower")) | (y > F.col("upper"))).alias("iqr_outliers"),
        F.count_if(F.abs(y - F.col("_m")) > F.col("_s") * F.lit(threshold)).alias("z_outliers"),
    )


def winsorise(
    df: DataFrame, method: str = "iqr", *, series: str = "series_id", target: str = "y",
    cfg: Config = DEFAULTS, plan: str = "auto",
) -> DataFrame:
    """Clip the target to its per-series bounds; no row is dropped.

    The bounds are one row per series: AQE broadcasts them when their measured
    size allows and otherwise splits a hot series in the shuffled join."""
    if method not in ("iqr", "zscore"):
        log.warning("unknown outlier method %r; target left as it is", method)
        return df
    limits = bounds(df, method, series=series, target=target, cfg=cfg, plan=plan)
    y = F.col(target)
    clipped = F.when(y.isNotNull(), F.least(F.greatest(y, F.col("lower")), F.col("upper")))
    out = df.join(limits, series, "left")
    return out.select(*[clipped.alias(target) if c == target else F.col(c) for c in df.columns])


def clean(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", target: str = "y",
    ingest_order: str | None = None, winsorized: bool = True, cfg: Config = DEFAULTS, plan: str = "auto",
) -> DataFrame:
    """Deduplicate, fill gaps, cap outliers.

    The filled series is read twice for capping (bounds, then clipping), so it is written once."""
    plan = choose_plan(df, [series], plan)  # duplicates only make this an upper bound
    out = dedup_first(df, series=series, ts=ts, ingest_order=ingest_order)
    if ingest_order:
        out = out.drop(ingest_order)
    out = fill_missing(out, cfg.missing_strategy, series=series, ts=ts, target=target, limit=cfg.interpolate_limit, plan=plan)
    if not winsorized:
        return out
    return winsorise(reliable(out), cfg.outlier_method, series=series, target=target, cfg=cfg, plan=plan)
