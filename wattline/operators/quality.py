"""Schema checks and data-quality reports."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


class ValidationError(ValueError):
    """Raised by ``validate`` with every failed check in one message."""


def checks(df: DataFrame, *, series: str = "series_id", target: str = "y", min_rows: int = 100) -> DataFrame:
    """Row count, target null share and the resulting verdicts, one row per series."""
    null_pct = F.avg(F.col(target).isNull().cast("int")) * 100
    out = df.groupBy(series).agg(F.count(F.lit(1)).alias("n_rows"), null_pct.alias("null_pct"))
    return out.withColumns({
        "too_small": F.col("n_rows") < min_rows,
        "all_null": F.col("null_pct") == 100,
        "mostly_null": (F.col("null_pct") > 50) & (F.col("null_pct") < 100),
    })


def rejected(df: DataFrame, *, series: str = "series_id", target: str = "y", min_rows: int = 100) -> DataFrame:
    """Series that fail a check, with the reason; the others can go on without them."""
    found = checks(df, series=series, target=target, min_rows=min_rows).filter("too_small or all_null")
    reason = F.when(F.col("all_null"), "target is entirely null").otherwise(
        F.concat(F.lit("too few rows: "), F.col("n_rows").cast("string"), F.lit(f" (minimum {min_rows})")))
    return found.select(series, "n_rows", "null_pct", reason.alias("reason"))


def validate(
    df: DataFrame, *, required: Sequence[str] = ("ts", "y"), ts: str = "ts", target: str = "y",
    min_rows: int = 100,
) -> None:
    """Raise ``ValidationError`` listing all problems: time key type, missing columns,
    fewer than ``min_rows`` rows, target all null. Warn over half null."""
    errors: list[str] = []
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    if not isinstance(types.get(ts), (T.TimestampType, T.TimestampNTZType)):
        errors.append(f"time key {ts!r} must be a timestamp")
    missing = [c for c in required if c != ts and c not in types]
    if missing:
        errors.append(f"missing required columns: {missing}")
    aggs = [F.count(F.lit(1)).alias("n")]
    if target in types:
        aggs.append(F.count_if(F.col(target).isNull()).alias("nulls"))
    row = df.agg(*aggs).first()
    if row["n"] < min_rows:
        errors.append(f"too few rows: {row['n']} (minimum {min_rows})")
    if target in types and row["n"]:
        if row["nulls"] == row["n"]:
            errors.append(f"target {target!r} is entirely null")
        elif row["nulls"] > row["n"] / 2:
            log.warning("target %r is %.1f%% null", target, 100 * row["nulls"] / row["n"])
    if errors:
        raise ValidationError("validation failed: " + "; ".join(errors))


def report(df: DataFrame, *, series: str | None = "series_id", ts: str = "ts") -> DataFrame:
    """Long quality report: nulls and null share per column, beside the table's row and
    column counts, date range and number of repeated (series, timestamp) rows."""
    keys = [k for k in (series, ts) if k]
    # Two-level aggregation: distinct keys are combined on the map side, no expand.
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    n_cols = len(df.columns)
    total = per_key.agg(
        F.sum("_n").alias("total_rows"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicated_rows"),
        F.min(ts).alias("date_start"),
        F.max(ts).alias("date_end"),
        *[F.sum(f"_m{i}").alias(f"_m{i}") for i in range(n_cols)],
    )
    pairs = ", ".join(f"'{c}', _m{i}" for i, c in enumerate(df.columns))
    long = total.selectExpr(
        "total_rows", "duplicated_rows", "date_start", "date_end",
        f"stack({n_cols}, {pairs}) as (column_name, missing)",
    )
    share = F.round(F.try_divide(F.col("missing") * 100.0, F.col("total_rows")), 2)
    return long.select(
        "column_name", "missing", share.alias("missing_pct"), "total_rows",
        F.lit(n_cols).alias("total_columns"), "duplicated_rows", "date_start", "date_end",
    )
