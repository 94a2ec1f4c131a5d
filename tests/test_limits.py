from collections import deque

import numpy as np
import pandas as pd
import pytest

from wattline.operators.limits import sliding_limit
from wattline.streaming.limits import SlidingLimit, decide, decide_all, sliding_limit_stream

BASE = pd.Timestamp("2024-01-01")


def brute(pdf, cap, window):
    out = {}
    for _, g in pdf.sort_values(["ts", "event_id"]).groupby("key"):
        kept = deque()
        for r in g.itertuples():
            while kept and (r.ts - kept[0]).total_seconds() > window:
                kept.popleft()
            ok = len(kept) < cap
            out[r.event_id] = ok
            if ok:
                kept.append(r.ts)
    return out


@pytest.fixture(scope="module")
def traffic():
    """One key holds most events in bursts that never pause; others are quiet or bursty."""
    rng = np.random.default_rng(4)
    times = {
        "hot": np.cumsum(rng.exponential(2.0, 1500)),
        "bursts": np.sort(np.concatenate([b + rng.uniform(0, 20, 40) for b in (0, 61, 130, 500, 1000)])),
        "calm": np.arange(0, 3000, 30.0),
        "edge": np.repeat(np.arange(0, 600, 60.0), 6),
    }
    rows = [(k, BASE + pd.Timedelta(microseconds=int(t * 1e6))) for k, ts in times.items() for t in ts]
    pdf = pd.DataFrame(rows, columns=["key", "ts"]).sample(frac=1.0, random_state=1).reset_index(drop=True)
    pdf["event_id"] = pdf.sort_values("ts").reset_index()["index"].argsort()
    return pdf


def as_frame(spark, pdf):
    return spark.createDataFrame([(r.key, r.ts.to_pydatetime(), int(r.event_id)) for r in pdf.itertuples()], "key string, ts timestamp_ntz, event_id long")


@pytest.mark.parametrize("cap", [1, 5, 20, 100])
def test_matches_brute_force(spark, traffic, cap):
    got = sliding_limit(as_frame(spark, traffic), key="key", max_events=cap, window_seconds=60, tie="event_id").toPandas()
    assert len(got) == len(traffic)
    assert dict(zip(got["event_id"], got["accepted"])) == brute(traffic, cap, 60)
    assert got.loc[got["accepted"], "retry_after_seconds"].isna().all()
    assert got.loc[~got["accepted"], "retry_after_seconds"].between(0, 60).all()


def test_stream_agrees(spark, traffic, tmp_path):
    ordered = traffic.sort_values(["ts", "event_id"]).reset_index(drop=True)
    for i, part in enumerate(np.array_split(np.arange(len(ordered)), 3)):
        as_frame(spark, ordered.iloc[part]).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    source = spark.readStream.schema("key string, ts timestamp_ntz, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    out = sliding_limit_stream(source, key="key", max_events=5, window_seconds=60)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = spark.sql("select * from limited").toPandas()
    assert dict(zip(got["event_id"], got["accepted"])) == brute(ordered, 5, 60)


def test_bucket_is_decided_at_once():
    """Many keys of a bucket in one call give what each gives by itself, over several micro-batches, late events and null keys included."""
    rng = np.random.default_rng(9)
    span, cap, state, single = 60, 4, [], {}
    for batch in range(6):
        n = 400
        names = np.array([None if k == 7 else f"k{k}" for k in np.minimum(rng.geometric(0.15, n), 30)], object)
        times, ids = rng.integers(batch * 300 - 40, batch * 300 + 300, n), rng.permutation(n) + batch * n
        order, accepted, wait, state = decide_all(names, times, ids, state, cap, span)
        assert sorted(order.tolist()) == list(range(n)) and len({name for name, _ in state}) == len(state)
        got = {int(ids[o]): (bool(a), int(w)) for o, a, w in zip(order, accepted, wait)}
        for name in set(names):
            own = np.array([x == name for x in names])
            placed = np.lexsort([ids[own], times[own]])
            ok, late, single[name] = decide(times[own][placed], single.get(name, []), cap, span)
            assert [got[int(i)] for i in ids[own][placed]] == [(bool(a), int(w)) for a, w in zip(ok, late)]
    assert {name for name, _ in state} == set(single)


def test_calls_to_the_state_do_not_grow_with_keys(monkeypatch):
    """A bucket of a thousand keys reads and writes its state once a micro-batch."""
    calls = []

    class State:
        rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = rows

        def clear(self):
            calls.append("clear")
            self.rows = []

    class Handle:
        state = State()
        getListState = lambda self, *a: self.state
        listTimers = lambda self: iter([])
        deleteTimer = registerTimer = lambda self, t: calls.append("timer")

    class Timers:
        now = 0
        getCurrentWatermarkInMs = lambda self: self.now

    limit, timers = SlidingLimit("key", "event_id", 2, 1_000_000), Timers()
    limit.init(Handle())
    for k in range(3):
        rows = pd.DataFrame({"key": [f"u{i}" for i in range(1000)] * 3, "event_id": range(3000), "ts_us": [k * 10_000_000] * 3000})
        out = pd.concat(limit.handleInputRows((5,), iter([rows]), timers))
        assert out.groupby("key")["accepted"].sum().eq(2).all() and len(out) == 3000 and out["retry_after_seconds"].notna().sum() == 1000
        timers.now = k * 10_000 + 5_000
    assert calls == ["get", "put", "timer"] * 3 and all(len(times) == 2 for _, times in Handle.state.rows)
