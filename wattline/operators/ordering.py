"""Row order inside a series without putting a series into one task.

A window partitioned by series is one task per series. That is the cheapest plan
while every series fits a task, and the wrong one when a single series holds a
large share of the table. Operators here take ``plan``:

``plain``
    one window per series;
``chunked``
    range-partition by (series, order), number the rows, cut the series into
    chunks of a fixed row count and copy a halo of neighbouring rows;
``auto`` (default)
    count rows per series (a map-side combined count) and use ``chunked`` only when
    the largest series is over ``MAX_GROUP_ROWS``.

Both plans give the same rows and values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.session import reliable

MAX_GROUP_ROWS = 4_000_000
CHUNK_ROWS = 500_000
# Spark limits window groups on the map side up to its default threshold of 1,000 rows.
GROUP_LIMIT_ROWS = 1_000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest key; one small row reaches the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def choose_plan(df: DataFrame, keys: Sequence[str], plan: str = "auto") -> str:
    if plan in ("plain", "chunked"):
        return plan
    if plan != "auto":
        raise ValueError(f"unknown plan {plan!r}")
    return "plain" if largest_group(df, keys) <= MAX_GROUP_ROWS else "chunked"


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    pos: str = "pos",
    total: str | None = None,
    plan: str = "auto",
) -> DataFrame:
    """Add the 0-based row position per key and, if named, the rows per key."""
    plan = choose_plan(df, keys, plan)
    if plan == "plain":
        w = Window.partitionBy(*keys)
        out = df.withColumn(pos, (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
        return out.withColumn(total, F.count(F.lit(1)).over(w)) if total else out

    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = [F.col(k) for k in keys]
    ranged = (
        df.repartitionByRange(*key_cols, *order_cols)
        .sortWithinPartitions(*key_cols, *order_cols)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # Range bounds are sampled, so the ids are fixed here once.
    ranged = reliable(ranged).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    # One row per (key, range partition): at most keys + partitions rows.
    parts = ranged.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
    )
    w = Window.partitionBy(*keys)
    parts = parts.withColumn(
        "_before", F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    )
    if total:
        parts = parts.withColumn(total, F.sum("_rows").over(w))
    out = ranged.join(parts.drop("_rows"), [*keys, "_part"]).withColumn(
        pos, F.col("_id") - F.col("_first") + F.coalesce("_before", F.lit(0))
    )
    return out.drop("_id", "_part", "_first", "_before")


def halo_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    before: int = 0,
    after: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    plan: str = "auto",
) -> tuple[DataFrame, list[str]]:
    """Cut every key into chunks; returns the frame and its partition columns.

    Each chunk also holds the last ``before`` rows of the chunk in front and the first
    ``after`` rows of the chunk behind it. They carry ``_halo = true``; drop them
    with ``drop_halo`` once the window values are there. ``_pos`` is the row position.
    """
    plan = choose_plan(df, keys, plan)
    if plan == "plain":
        return df, list(keys)
    if chunk_rows <= max(before, after):
        raise ValueError("chunk_rows must exceed the halo")
    out = positions(df, keys, order, pos="_pos", plan="chunked")
    home = F.floor(F.col("_pos") / chunk_rows)
    offset = F.col("_pos") % chunk_rows
    targets = F.filter(
        F.array(
            home,
            F.when(offset >= chunk_rows - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        ),
        lambda c: c.isNotNull(),
    )
    out = out.withColumn("_home", home).withColumn("_chunk", F.explode(targets))
    out = out.withColumn("_halo", F.col("_chunk") != F.col("_home")).drop("_home")
    return out, [*keys, "_chunk"]


def drop_halo(df: DataFrame, *, keep_position: bool = False) -> DataFrame:
    if "_halo" not in df.columns:
        return df
    out = df.filter(~F.col("_halo")).drop("_halo", "_chunk")
    return out if keep_position else out.drop("_pos")


def _ends(df: DataFrame, low: int, high: int, *, series: str, ts: str, newest: bool) -> DataFrame:
    """Rows ``low`` to ``high`` (exclusive) of each series, counted from its newest or oldest row."""
    order = F.col(ts).desc() if newest else F.col(ts)
    if high <= GROUP_LIMIT_ROWS:
        # ``row_number() <= n`` becomes a group limit on the map side, so a hot series sends at most n rows per task
        w = Window.partitionBy(series).orderBy(order)
        out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= high)
        return out.filter(F.col("_rn") > low).drop("_rn")
    # more rows than a task should hold of a series: global positions from range partitions
    ranked = positions(df, [series], [order], pos="_rn", plan="chunked")
    return ranked.filter((F.col("_rn") >= low) & (F.col("_rn") < high)).drop("_rn")


def tail(
    df: DataFrame, n: int, *, series: str = "series_id", ts: str = "ts", skip: int = 0
) -> DataFrame:
    """Last ``n`` rows per series after skipping the newest ``skip`` rows; both plans give the same rows."""
    return _ends(df, skip, n + skip, series=series, ts=ts, newest=True)


def head(df: DataFrame, n: int, *, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """First ``n`` rows per series."""
    return _ends(df, 0, n, series=series, ts=ts, newest=False)


def quantiles(
    df: DataFrame,
    col: str,
    probs: dict[str, float],
    *,
    keys: Sequence[str] = ("series_id",),
    plan: str = "auto",
) -> DataFrame:
    """Exact linear-interpolated quantiles of the non-null values, one row per key.

    ``percentile`` holds every distinct value of a key in one buffer; over
    ``MAX_GROUP_ROWS`` the wanted order statistics are picked by row position instead.
    """
    values = df.filter(F.col(col).isNotNull()).select(*keys, col)
    plan = choose_plan(values, keys, plan)
    if plan == "plain":
        array = F.percentile(col, F.array(*[F.lit(float(p)) for p in probs.values()]))
        return (
            values.groupBy(*keys)
            .agg(array.alias("_q"))
            .select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
        )
    ranked = positions(values, keys, [col], pos="_pos", total="_n", plan="chunked")
    aggs = []
    wanted = F.lit(False)
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        wanted = wanted | (F.col("_pos") == low) | (F.col("_pos") == high)
        lo = F.max(F.when(F.col("_pos") == low, F.col(col)))
        hi = F.max(F.when(F.col("_pos") == high, F.col(col)))
        aggs.append((lo + (hi - lo) * F.max(at - low)).alias(name))
    return ranked.filter(wanted).groupBy(*keys).agg(*aggs)
