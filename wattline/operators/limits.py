"""Sliding-window acceptance: at most ``max_events`` accepted events per key and window.

Whether an event is accepted depends on which earlier ones were, so an overloaded
stretch of one key is sequential. Everything else is not, and is settled on the JVM:

* Time is cut into buckets one window long. An event sees its own bucket and the one
  before, so when both together hold at most ``max_events`` events, all of its
  bucket are accepted ("calm").
* A calm bucket also fixes the state behind it, so an overloaded run of buckets needs only
  the bucket in front as its seed. Runs are independent of each other: one hot key is
  split at every calm bucket.
* Runs are sorted by Spark and streamed through ``mapInPandas`` holding only the last
  ``max_events`` accepted times. Rejected stretches are skipped by binary search, so the
  sequential work grows with the accepted events, which the limit itself bounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.calendar import epoch_us


def sliding_limit(
    df: DataFrame, *, key: str, ts: str = "ts", max_events: int = 100, window_seconds: int = 60,
    tie: str | None = None,
) -> DataFrame:
    """Input rows plus ``accepted`` and ``retry_after_seconds`` (null when accepted)."""
    span = window_seconds * 1_000_000
    rows = df.withColumn("_t", epoch_us(ts)).withColumn("_b", F.floor(F.col("_t") / span))
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_b")
    before = F.when(F.lag("_b").over(w) == F.col("_b") - 1, F.lag("_n").over(w)).otherwise(0)
    buckets = counts.withColumn("_busy", F.col("_n") + before > max_events)
    # A busy run starts at a busy bucket whose predecessor is calm or absent.
    linked = F.coalesce(F.lag("_busy").over(w) & (F.lag("_b").over(w) == F.col("_b") - 1), F.lit(False))
    buckets = buckets.withColumn("_starts", F.col("_busy") & ~linked)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.withColumn("_run", F.sum(F.col("_starts").cast("long")).over(running))
    next_busy = F.coalesce((F.lead("_b").over(w) == F.col("_b") + 1) & F.lead("_busy").over(w), F.lit(False))
    # A calm bucket in front of a run is copied into it as the seed.
    buckets = buckets.withColumn("_seeds", ~F.col("_busy") & next_busy).select(key, "_b", "_busy", "_seeds", "_run")

    marked = rows.join(buckets, [key, "_b"])
    calm = marked.filter(~F.col("_busy")).select(
        *df.columns, F.lit(True).alias("accepted"), F.lit(None).cast("long").alias("retry_after_seconds")
    )
    seed = marked.filter(F.col("_seeds")).withColumns({"_run": F.col("_run") + 1, "_seed": F.lit(True)})
    busy = marked.filter(F.col("_busy")).withColumn("_seed", F.lit(False)).unionByName(seed)
    order = [key, "_run", "_t", *([tie] if tie else [])]
    busy = busy.repartition(key, "_run").sortWithinPartitions(*order).select(*df.columns, "_run", "_t", "_seed")
    schema = T.StructType([
        *df.schema.fields,
        T.StructField("accepted", T.BooleanType()),
        T.StructField("retry_after_seconds", T.LongType()),
    ])
    columns = df.columns

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for batch in batches:
            times = batch["_t"].to_numpy()
            ok, retry = np.ones(len(batch), dtype=bool), np.zeros(len(batch), dtype="int64")
            new_run = (batch[key] != batch[key].shift()) | (batch["_run"] != batch["_run"].shift())
            starts = [*np.flatnonzero(new_run.to_numpy()), len(batch)]
            for first, end in zip(starts, starts[1:]):
                run = (batch[key].iloc[first], batch["_run"].iloc[first])
                if run != current:
                    current, recent = run, deque()
                i = first
                while i < end:
                    while recent and recent[0] < times[i] - span:
                        recent.popleft()
                    if len(recent) < max_events:
                        recent.append(times[i])
                        i += 1
                        continue
                    # Full until the oldest accepted event leaves: skip there in one step.
                    free = first + int(np.searchsorted(times[first:end], recent[0] + span, side="right"))
                    ok[i:free] = False
                    retry[i:free] = (span - (times[i:free] - recent[0])) // 1_000_000
                    i = free
            out = batch[columns].assign(accepted=ok, retry_after_seconds=pd.Series(retry, index=batch.index, dtype="Int64").mask(ok))
            yield out[~batch["_seed"].to_numpy(dtype=bool)]

    return calm.unionByName(busy.mapInPandas(decide, schema))
