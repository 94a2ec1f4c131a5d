"""Streaming twin of the sliding-window limit: accepted times per key as list state of buckets, cleared by timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattline.functions.calendar import epoch_us

# The state store that lists and timers need.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Decided events that are given at a time.
OUT_ROWS = 100_000
# Buckets that keys are dealt to; each is a group of the stream with a state of its own.
BUCKETS = 1024


def decide(times: np.ndarray, recent: list[int], max_events: int, span: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Which of the sorted times are accepted after the ``recent`` accepted ones, how many whole seconds the others must wait, and the
    accepted times that still count. Rejected stretches are skipped by binary search."""
    accepted, wait, i = np.ones(len(times), bool), np.zeros(len(times), np.int64), 0
    recent, start = list(recent), 0
    while i < len(times):
        while start < len(recent) and recent[start] < times[i] - span:
            start += 1
        if len(recent) - start < max_events:
            recent.append(int(times[i]))
            i += 1
            continue
        free = int(np.searchsorted(times, recent[start] + span, "right"))
        accepted[i:free] = False
        wait[i:free] = (span - (times[i:free] - recent[start])) // 1_000_000
        i = free
    return accepted, wait, recent[max(start, len(recent) - max_events):]


def decide_all(names: np.ndarray, times: np.ndarray, ids: np.ndarray, before: list[tuple[str, list[int]]], max_events: int, span: int):
    """Decides the events of many keys, each after its accepted times in ``before``.

    Returns the order of the events that the next two follow (by key, time and id), what is accepted, the whole seconds to wait, and
    the times that still count by key. Keys of which no event has ``max_events`` others within its window are settled at once; only
    the others are walked by ``decide``."""
    sizes = [len(t) for _, t in before]
    old = sum(sizes)
    held = np.array([n for n, _ in before], object).repeat(sizes) if old else np.zeros(0, object)
    codes, known = pd.factorize(np.concatenate([held, names]), use_na_sentinel=False)
    t = np.concatenate([np.array([x for _, own in before for x in own], np.int64), times])
    new = np.arange(len(t)) >= old
    # accepted times of a key first, as they are; then its events by time and id
    order = np.lexsort([np.concatenate([np.zeros(old, np.int64), ids]), np.where(new, t, np.arange(len(t))), new, codes])
    codes, t, new = codes[order], t[order], new[order]
    ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True)) + 1
    starts = np.append(0, ends[:-1])
    busy = np.zeros(len(known), bool)
    busy[codes[1:][(codes[1:] == codes[:-1]) & (t[1:] < t[:-1])]] = True
    full = (codes[max_events:] == codes[:-max_events]) & new[max_events:] & (t[max_events:] - t[:-max_events] <= span)
    busy[codes[max_events:][full]] = True
    accepted, wait, kept = np.ones(len(t), bool), np.zeros(len(t), np.int64), []
    for code, start, end in zip(codes[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        if busy[code]:
            middle = start + int(np.count_nonzero(~new[start:end]))
            accepted[middle:end], wait[middle:end], recent = decide(t[middle:end], t[start:middle].tolist(), max_events, span)
        else:
            recent = t[max(start, end - max_events):end]
            recent = (recent[recent >= t[end - 1] - span] if new[end - 1] else recent).tolist()
        kept.append((None if pd.isna(known[code]) else known[code], recent))
    return order[new] - old, accepted[new], wait[new], kept


class SlidingLimit(StatefulProcessor):
    """State of a bucket of keys: at most ``max_events`` accepted times of each. A timer one window after the newest clears them."""

    def __init__(self, key: str, event_id: str, max_events: int, span: int) -> None:
        self.key, self.event_id, self.max_events, self.span = key, event_id, max_events, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recent = handle, handle.getListState("recent", "name string, times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a name and two numbers per event of the micro-batch, whatever else its rows hold
        parts = [(b[self.key].to_numpy(object), b["ts_us"].to_numpy(np.int64), b[self.event_id].to_numpy(np.int64)) for b in rows]
        names, times, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        before = [(r[0], [int(x) for x in r[1]]) for r in self.recent.get()]
        order, accepted, wait, kept = decide_all(names, times, ids, before, self.max_events, self.span)
        # no event of a later micro-batch is older than this one's watermark
        counts = timerValues.getCurrentWatermarkInMs() * 1000 - self.span
        kept = [(name, own) for name, recent in kept if (own := [x for x in recent if x >= counts])]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.recent.put(kept)
            newest = max(x for _, own in kept for x in own)
            self.handle.registerTimer(max((newest + self.span) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.recent.clear()
        names, times, ids = names[order], times[order], ids[order]
        for k in range(0, len(times), OUT_ROWS):
            own = slice(k, k + OUT_ROWS)
            yield pd.DataFrame({self.key: names[own], self.event_id: ids[own], "ts_us": times[own], "accepted": accepted[own],
                                "retry_after_seconds": pd.Series(wait[own], dtype="Int64").mask(accepted[own])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame({self.key: pd.Series(dtype=str), self.event_id: pd.Series(dtype="int64"), "ts_us": pd.Series(dtype="int64"),
                            "accepted": pd.Series(dtype=bool), "retry_after_seconds": pd.Series(dtype="Int64")})

    def close(self) -> None:
        pass


def sliding_limit_stream(
    events: DataFrame, *, key: str, ts: str = "ts", event_id: str = "event_id", max_events: int = 100,
    window_seconds: int = 60, watermark: str = "10 minutes", buckets: int = BUCKETS,
) -> DataFrame:
    """Decide each event of a stream: ``key, event_id, ts_us, accepted, retry_after_seconds``.

    Events of one micro-batch are taken in time order; an event later than the watermark is dropped by the engine before it gets
    here. Keys share ``buckets`` by hash, and a bucket's state is read, decided and written at once: calls to the state store cost far more
    than events, and there is a handful of them per bucket and micro-batch, not per key. A hot key is one task by nature, since acceptance
    depends on what was accepted before: a bucket holds a name and two numbers per event of a micro-batch, whose size the source sets. Sets the session's state store, if none is set, to the one that lists and timers
    need."""
    if events.sparkSession.conf.get(STATE_STORE, "").endswith("HDFSBackedStateStoreProvider") or not events.sparkSession.conf.get(STATE_STORE, ""):
        events.sparkSession.conf.set(STATE_STORE, ROCKS)
    stamped = events.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", watermark)
    narrow = stamped.select(F.col(key).cast("string").alias(key), F.col(event_id).cast("long").alias(event_id), "_event_time", epoch_us("_event_time").alias("ts_us"))
    schema = f"{key} string, {event_id} long, ts_us long, accepted boolean, retry_after_seconds long"
    narrow = narrow.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    processor = SlidingLimit(key, event_id, max_events, window_seconds * 1_000_000)
    return narrow.groupBy("_bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="EventTime")
