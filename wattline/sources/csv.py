"""Energy CSV ingestion."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.config import DEFAULTS, Config
from wattline.functions.scalar import safe_double

# Accepted time column names, in order of preference, and a warning of uploads.
TIMESTAMP_COLUMNS = ["utc_timestamp", "timestamp", "datetime", "date", "time"]
OTHER_TARGET = "Target column not found; using '{}' as target."
# Column with the place of a record's line.
ORDER = "ingest_order"


def parse_timestamp(c: Column) -> Column:
    """UTC timestamp, or null when the text is not one."""
    return F.try_to_timestamp(c)


def line_order() -> Column:
    """Place of a row in the files that are read: file name, first byte of the split, line in the task.

    Splits of a file are tasks of their own, and a task may read several; a task numbers its rows in the order of lines, so within a split
    the numbers follow the lines, and file and first byte order the splits. It must be taken where the files are
    read, before any shuffle. Splits and names are the same when a lost task runs again."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"))


def read_text_columns(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, ingest_order: str | None = None
) -> DataFrame:
    """CSV with a header, every column a string; only ``columns`` are parsed. ``ingest_order`` names a column to add with the place
    of the line."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    columns = list(dict.fromkeys(columns)) if columns else df.columns
    if ingest_order is None:
        return df.select(*columns)
    if ingest_order in columns:
        raise ValueError(f"the file has a column {ingest_order!r}; name the order otherwise")
    return df.select(*columns, line_order().alias(ingest_order))


def coerce(
    df: DataFrame, *, ts: str, numeric: Sequence[str], out_ts: str = "ts",
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Parse the time column, drop rows without a time, coerce numbers, apply the range.

    ``end`` is a point in time: a plain date keeps only midnight of that day."""
    text = dict(df.dtypes)[ts] == "string"
    stamp = parse_timestamp(F.col(ts)) if text else F.col(ts)
    rest = [c for c in df.columns if c != ts]
    cols = [safe_double(F.col(c)).alias(c) if c in numeric else F.col(c) for c in rest]
    out = df.select(stamp.alias(out_ts), *cols).na.drop(subset=[out_ts])
    kind = "timestamp_ntz" if dict(out.dtypes)[out_ts] == "timestamp_ntz" else "timestamp"
    if start:
        out = out.filter(F.col(out_ts) >= F.lit(start).cast(kind))
    if end:
        out = out.filter(F.col(out_ts) <= F.lit(end).cast(kind))
    return out


def first_rows(df: DataFrame, n: int, *, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ``order``. Files have no global row order on a cluster,
    so the order is always explicit; each task keeps at most ``n`` rows before the merge."""
    return df.orderBy(*order).limit(n)


def load(
    spark: SparkSession, path: str, *, timestamp: str = "utc_timestamp", target: str = "y",
    exog: Sequence[str] = (), series_id: str | None = "all", max_rows: int | None = None, ingest_order: str | None = None,
    cfg: Config = DEFAULTS,
) -> DataFrame:
    """Read only the time, target and exogenous columns, coerce them and cut the range.

    ``ingest_order`` names a column to add with the place of the line, which ``clean`` and the runs take to keep the first of copied
    times. The row cap applies before the range filter: to the first lines of the files with an order, else to the
    oldest rows."""
    df = read_text_columns(spark, path, [timestamp, target, *exog], ingest_order=ingest_order)
    numeric = [target, *exog]
    if max_rows and ingest_order:
        df = first_rows(df, max_rows, order=[ingest_order])
        df = coerce(df, ts=timestamp, numeric=numeric, start=cfg.start_date, end=cfg.end_date)
    elif max_rows:
        df = coerce(df, ts=timestamp, numeric=numeric)
        df = first_rows(df, max_rows, order=["ts", *numeric])
        df = coerce(df, ts="ts", numeric=[], start=cfg.start_date, end=cfg.end_date)
    else:
        df = coerce(df, ts=timestamp, numeric=numeric, start=cfg.start_date, end=cfg.end_date)
    out = df.withColumnRenamed(target, "y")
    return out.select(F.lit(series_id).alias("series_id"), *out.columns) if series_id else out


def load_supplementary(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def timestamp_column(columns: Sequence[str]) -> str:
    for name in TIMESTAMP_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no time column; expected one of {TIMESTAMP_COLUMNS}")


def _number_columns(df: DataFrame, stamp: str) -> list[str]:
    """Text columns with a number in every row that is not empty, and in one at least; one aggregate."""
    names = [f.name for f in df.schema.fields if f.name != stamp and isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    row = df.agg(*[F.struct(F.count(filled(c)).alias("n"), F.count(safe_double(F.col(c))).alias("m")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[i]["m"] and row[i]["n"] == row[i]["m"]]


def upload_file(spark: SparkSession, path: str, stored: str, *, owner: str, **options) -> DataFrame:
    """Reads a CSV file, appends its records with their order to the stored table at ``stored`` and returns the summary."""
    from wattline.sources.records import append_records

    lines = read_text_columns(spark, path, ingest_order=ORDER)
    records, summary = upload(lines, owner=owner, source=path.rpartition("/")[2], ingest_order=ORDER, **options)
    append_records(records, stored)
    return summary


def upload(
    df: DataFrame, *, owner: str, source: str, target: str = "y", unit: str = "MW", ingest_order: str | None = None,
    uploaded_at: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Uploaded frame to ``(records, summary)``.

    ``ingest_order`` names the column of ``read_text_columns`` with the place of the line; records then hold it after the time of
    the upload, so that of copied times in several uploads the first line of the first upload comes first.
    The target falls back to the first numeric column with a warning. Rows with a bad
    time are dropped, rows with a null target are rejected. The summary is one row
    from one aggregate."""
    order = [ingest_order] if ingest_order else []
    at = F.lit(uploaded_at or datetime.now(timezone.utc)).cast("timestamp")
    placed = [F.struct(at.alias("uploaded_at"), *(F.col(f"{c}.{p}").alias(p) for p in ("file", "block", "line"))).alias(ORDER) for c in order]
    lines, df = df, df.drop(*order)
    stamp = timestamp_column(df.columns)
    warnings: list[str] = []
    source_target = target
    if target not in df.columns:
        numeric = [
            f.name for f in df.schema.fields
            if f.name != stamp and isinstance(f.dataType, (T.NumericType,))
        ]
        if not numeric:
            numeric = _number_columns(df, stamp)
        if not numeric:
            raise ValueError(f"required column {target!r} not found; available: {df.columns}")
        source_target = numeric[0]
        warnings.append(OTHER_TARGET.format(source_target))
    text = dict(df.dtypes)[stamp] == "string"
    ts = parse_timestamp(F.col(stamp)) if text else F.col(stamp)
    parsed = lines.select(ts.alias("ts"), safe_double(F.col(source_target)).alias("value"), *placed).na.drop(subset=["ts"])
    records = parsed.na.drop(subset=["value"]).select(
        F.lit(owner).alias("series_id"), "ts", "value", F.lit(unit).alias("unit"), F.lit(source).alias("source_file"),
        *([ORDER] if placed else [])
    )
    columns = [target if c == source_target else c for c in df.columns if c != stamp]
    summary = parsed.agg(
        F.lit(source).alias("filename"),
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count("value").alias("rows_valid"),
        F.count_if(F.col("value").isNull()).alias("rows_rejected"),
        F.lit(columns).cast("array<string>").alias("columns"),
        F.create_map(
            F.lit("start"), F.coalesce(F.min("ts").cast("string"), F.lit("unknown")),
            F.lit("end"), F.coalesce(F.max("ts").cast("string"), F.lit("unknown")),
        ).alias("time_range"),
        F.lit(warnings).cast("array<string>").alias("warnings"),
    )
    return records, summary
