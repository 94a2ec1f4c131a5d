"""Seasonal ARIMA with exogenous regressors by two-stage least squares (Hannan-Rissanen).

Stage one fits a long autoregression to the differenced series to get innovations,
stage two regresses it on its own lags, lagged innovations and differenced exogenous
columns. Both stages are per-series cross products over lag columns. Models with innovations or
seasonal factors then go on from there to conditional least squares over their factors
(``conditional``), where a cross lag is the product of its two factors. It stands in for a
maximum-likelihood state-space fit: same model family, the likelihood given zeros before the first row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.config import DEFAULTS
from wattline.models.conditional import MAX_STEPS, Factors, refine
from wattline.models.linear import cross_products, dot, solve
from wattline.operators.forecast import future_exog
from wattline.operators.features import windowed
from wattline.operators.ordering import choose_plan, tail
from wattline.session import reliable

# Model orders (p, d, q) and (P, D, Q, s).
ORDERS = {
    "ARIMA": ((2, 1, 2), (0, 0, 0, 0)),
    "SARIMA": ((1, 1, 1), (1, 1, 1, 24)),
    "SARIMAX": ((1, 1, 1), (1, 1, 1, 24)),
}


# Steps that one task computes of a series.
CHUNK_STEPS = 20_000


def difference_weights(d: int, seasonal_d: int, s: int) -> dict[int, float]:
    """Lag weights of (1 - B)^d (1 - B^s)^D, without the zeros."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal_d):
        poly = np.convolve(poly, np.concatenate([[1.0], np.zeros(s - 1), [-1.0]]))
    return {k: float(v) for k, v in enumerate(poly) if v}


def expanded_lags(short: int, long: int, s: int) -> list[int]:
    """Lags of (1 + .. B^short)(1 + .. B^(s long)) other than zero."""
    return sorted({i + s * j for i in range(short + 1) for j in range(long + 1)} - {0})


def _weighted(c: str, weights: dict[int, float], w) -> Column:
    """Weighted sum of a column and its lags; null where a lag is missing."""
    total = F.lit(0.0)
    for k, v in weights.items():
        total = total + (F.lag(c, k).over(w) if k else F.col(c)) * F.lit(v)
    return total


class LinearSteps:
    """Steps of a forecast as linear maps. A state holds the newest differences, then innovations, then values, newest first."""

    def __init__(self, ar: Sequence[int], ma: Sequence[int], weights: dict[int, float]) -> None:
        self.ar, self.ma, self.weights = list(ar), list(ma), dict(weights)
        self.p, self.q, self.r = max([0, *ar]), max([0, *ma]), max(weights)
        self.size = self.p + self.q + self.r

    def rows(self, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the state in the next difference and in the next value."""
        w, y = np.zeros(self.size), np.zeros(self.size)
        for k, c in zip([*self.ar, *(self.p + k for k in self.ma)], coef, strict=False):
            w[k - 1] = c
        for k, c in self.weights.items():
            if k:
                y[self.p + self.q + k - 1] = -c
        return w, w + y

    def matrix(self, coef: np.ndarray) -> np.ndarray:
        """The map of one step: a future innovation is zero."""
        out = np.zeros((self.size, self.size))
        w, y = self.rows(coef)
        for start, n, first in ((0, self.p, w), (self.p, self.q, None), (self.p + self.q, self.r, y)):
            if n and first is not None:
                out[start] = first
            for k in range(1, n):
                out[start + k, start + k - 1] = 1.0
        return out

    def run(self, coef: np.ndarray, state: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after the steps, and their values."""
        w_row, y_row = self.rows(coef)
        p, q, out = self.p, self.q, np.empty(len(given))
        state = state.copy()
        for i, u in enumerate(given.tolist()):
            w, y = w_row @ state + u, y_row @ state + u
            state[1:p], state[p + 1:p + q], state[p + q + 1:] = state[:max(0, p - 1)].copy(), state[p:p + q - 1].copy() if q else state[p:p], state[p + q:-1].copy()
            if p:
                state[0] = w
            if q:
                state[p] = 0.0
            if self.r:
                state[p + q] = y
            out[i] = y
        return state, out

    def state(self, first: np.ndarray, long: Sequence[int], y: np.ndarray) -> np.ndarray:
        """State after a history of values; what is not known of it counts as zero."""
        n, deepest = len(y), self.r
        w, e = np.full(n, np.nan), np.zeros(n)
        for i in range(deepest, n):
            w[i] = sum(c * y[i - k] for k, c in self.weights.items())
        for i in range(deepest + max(long), n):
            e[i] = np.nan_to_num(w[i] - first @ w[[i - k for k in long]])
        newest = lambda x, m: np.concatenate([x[::-1][:m], np.zeros(max(0, m - n))])
        return np.concatenate([np.nan_to_num(newest(w, self.p)), newest(e, self.q), newest(y, self.r)])


class ArimaModel:
    """Coefficients per series, and the newest training rows to start from.

    ``table`` has the coefficients of the model and of the long autoregression that gives innovations from
    observed values, so a forecast can start at the end of any history."""

    statistical = True

    def __init__(self, name, table, state, ar, ma, long, weights, exog, series, ts, target) -> None:
        self.name, self.table, self.state = name, table, state
        self.ar, self.ma, self.long, self.weights, self.exog = ar, ma, long, weights, list(exog)
        self.series, self.ts, self.target = series, ts, target

    def forecast(
        self, history: DataFrame | None, horizon: int, *, exog: Sequence[str] = (), future: DataFrame | None = None,
        chunk_steps: int = CHUNK_STEPS,
    ) -> DataFrame:
        """``horizon`` steps after the last row of ``history``, clipped at zero; without a history, after the training rows.
        ``future`` gives known exogenous values as ``series, step, ts, <exog>``; else they follow the profile of
        ``history``. More than ``chunk_steps`` steps are cut into chunks, and no task holds more of a series."""
        if future is not None:
            horizon = future.agg(F.max("step")).first()[0] or 0
        if future is None:
            future = future_exog(history, horizon, self.exog, series=self.series, ts=self.ts)
        if history is None:
            past = self.state
        else:
            past = _recent(history, self.target, self.exog, _reach(self.ar, self.ma, self.long, self.weights), self.series, self.ts)
        if horizon > chunk_steps:
            return self._scan(past, future, chunk_steps)
        past = past.withColumn("step", F.lit(0))
        coming = future.select(self.series, self.ts, F.lit(None).cast("double").alias("_y"), *self.exog, "step")
        frame = past.unionByName(coming).join(self.table.select(self.series, "coef", "long_coef"), self.series)
        ar, ma, long, weights, exog_cols, series, ts = self.ar, self.ma, self.long, self.weights, self.exog, self.series, self.ts
        schema = T.StructType([
            self.state.schema[series], T.StructField("step", T.IntegerType()), self.state.schema[ts],
            T.StructField("forecast", T.DoubleType()),
        ])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["step", ts], kind="stable").reset_index(drop=True)
            coef, first = np.asarray(pdf["coef"].iloc[0]), np.asarray(pdf["long_coef"].iloc[0])
            y, n = pdf["_y"].to_numpy(dtype=float).copy(), len(pdf)
            xs = pdf[exog_cols].to_numpy(dtype=float) if exog_cols else np.zeros((n, 0))
            start, deepest = int((pdf["step"] == 0).sum()), max(weights)
            w, e = np.full(n, np.nan), np.zeros(n)
            for i in range(deepest, start):
                w[i] = sum(c * y[i - k] for k, c in weights.items())
            for i in range(deepest + max(long), start):
                e[i] = np.nan_to_num(w[i] - first @ w[[i - k for k in long]])
            for i in range(start, n):
                x = [w[i - k] if i >= k else 0.0 for k in ar] + [e[i - k] if i >= k else 0.0 for k in ma]
                x += [sum(c * xs[i - k, j] for k, c in weights.items() if i >= k) for j in range(xs.shape[1])]
                w[i] = coef @ np.nan_to_num(np.asarray(x))
                y[i] = w[i] - sum(c * y[i - k] for k, c in weights.items() if k and i >= k)
            out = pdf.loc[start:, [series, "step", ts]].copy()
            out["forecast"] = np.clip(np.nan_to_num(y[start:], nan=0.0, posinf=np.finfo(float).max), 0.0, None)
            return out

        return frame.groupBy(series).applyInPandas(run, schema)

    def _scan(self, past: DataFrame, future: DataFrame, chunk_steps: int) -> DataFrame:
        """Forecast of any length. A step is a linear map of a state (the newest differences, innovations and values) and adds what
        exogenous columns give. Every chunk of steps runs once from a state of zeros; a power of the map carries states from chunk to
        chunk, a few numbers each; then every chunk runs from its own state."""
        ar, ma, long, weights, exog, series, ts = self.ar, self.ma, self.long, self.weights, self.exog, self.series, self.ts
        steps = LinearSteps(ar, ma, weights)
        coming = future.select(series, ts, "step", *exog)
        if exog:
            known = past.select(series, ts, F.lit(0).alias("step"), *exog).unionByName(coming)
            known = windowed(known, series, ts, max(weights), lambda w: {f"_d{c}": _weighted(c, weights, w) for c in exog}, "auto", None)
            coef = self.table.select(series, F.slice("coef", F.lit(len(ar) + len(ma) + 1), F.lit(len(exog))).alias("_cx"))
            given = dot([f"_d{c}" for c in exog], F.col("_cx"))
            coming = known.filter("step > 0").join(coef, series).select(series, ts, "step", F.coalesce(given, F.lit(0.0)).alias("_u"))
        else:
            coming = coming.withColumn("_u", F.lit(0.0))
        coming = reliable(coming.withColumn("_chunk", F.floor((F.col("step") - 1) / chunk_steps)))
        key = [coming.schema[series], coming.schema["_chunk"]]
        coefs = self.table.select(F.col(series).alias("_series"), "coef", "long_coef")
        of_chunk = coming.select(series, "_chunk").distinct().join(coefs, F.col(series) == F.col("_series")).select("_series", F.col("_chunk").alias("_at"), "coef")

        def ended(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({series: [], "_chunk": [], "size": [], "end": []})
            end, _ = steps.run(np.asarray(right["coef"].iloc[0]), np.zeros(steps.size), left.sort_values("step")["_u"].to_numpy(dtype=float))
            return pd.DataFrame({series: [left[series].iloc[0]], "_chunk": [left["_chunk"].iloc[0]], "size": [len(left)], "end": [end.tolist()]})

        ends = coming.groupBy(series, "_chunk").cogroup(of_chunk.groupBy("_series", "_at")).applyInPandas(
            ended, T.StructType([*key, T.StructField("size", T.LongType()), T.StructField("end", T.ArrayType(T.DoubleType()))]))

        def first(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(ts, kind="stable")
            state = steps.state(np.asarray(pdf["long_coef"].iloc[0]), long, pdf["_y"].to_numpy(dtype=float))
            return pd.DataFrame({"_series": [pdf[series].iloc[0]], "state": [state.tolist()], "coef": [pdf["coef"].iloc[0]]})

        starts = past.select(series, ts, "_y").join(self.table.select(series, "coef", "long_coef"), series).groupBy(series).applyInPandas(
            first, T.StructType([T.StructField("_series", T.StringType()), T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("coef", T.ArrayType(T.DoubleType()))]))

        def carried(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows = []
            if len(left) and len(right):
                state, one = np.asarray(right["state"].iloc[0], dtype=float), steps.matrix(np.asarray(right["coef"].iloc[0]))
                powers: dict[int, np.ndarray] = {}
                for r in left.sort_values("_chunk").itertuples(index=False):
                    rows.append((r[0], r[1], state.tolist(), right["coef"].iloc[0]))
                    if r.size not in powers:
                        powers[r.size] = np.linalg.matrix_power(one, int(r.size))
                    state = powers[r.size] @ state + np.asarray(r.end)
            return pd.DataFrame(rows, columns=["_series", "_at", "state", "coef"])

        arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("state", "coef")]
        states = ends.groupBy(series).cogroup(starts.groupBy("_series")).applyInPandas(
            carried, T.StructType([T.StructField("_series", T.StringType()), T.StructField("_at", T.LongType()), *arrays]))

        def told(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values("step")
            if not len(left) or not len(right):
                return left[[series, "step", ts]].head(0).assign(forecast=pd.Series(dtype=float))
            _, y = steps.run(np.asarray(right["coef"].iloc[0]), np.asarray(right["state"].iloc[0], dtype=float), left["_u"].to_numpy(dtype=float))
            return left[[series, "step", ts]].assign(forecast=np.clip(np.nan_to_num(y, nan=0.0, posinf=np.finfo(float).max), 0.0, None))

        schema = T.StructType([self.state.schema[series], T.StructField("step", T.IntegerType()), self.state.schema[ts], T.StructField("forecast", T.DoubleType())])
        return coming.groupBy(series, "_chunk").cogroup(states.groupBy("_series", "_at")).applyInPandas(told, schema)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/coefficients")
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        spark = self.table.sparkSession
        info = [(self.name, self.ar, self.ma, self.long, list(self.weights), list(self.weights.values()), self.exog, self.target)]
        spark.createDataFrame(
            info, "name string, ar array<int>, ma array<int>, long array<int>, wk array<int>, wv array<double>, exog array<string>, target string"
        ).write.mode("overwrite").parquet(f"{path}/info")

    @classmethod
    def load(cls, spark, path: str, series: str = "series_id", ts: str = "ts") -> ArimaModel:
        i = spark.read.parquet(f"{path}/info").first()
        return cls(
            i["name"], spark.read.parquet(f"{path}/coefficients"), spark.read.parquet(f"{path}/state"), list(i["ar"]),
            list(i["ma"]), list(i["long"]), dict(zip(i["wk"], i["wv"])), list(i["exog"]), series, ts, i["target"],
        )


def _reach(ar, ma, long, weights) -> int:
    """Rows that the first step and the innovations before it look back on."""
    return max([*ar, *ma, 1]) + max(long) + max(weights) + 1


def _recent(df: DataFrame, target: str, exog: Sequence[str], rows: int, series: str, ts: str) -> DataFrame:
    return tail(df.select(series, ts, F.col(target).cast("double").alias("_y"), *exog), rows, series=series, ts=ts)


def fit_arima(
    df: DataFrame, *, name: str = "ARIMA", order: tuple | None = None, seasonal: tuple | None = None,
    exog: Sequence[str] = (), series: str = "series_id", ts: str = "ts", target: str = "y",
    max_rows: int | None = DEFAULTS.stat_train_rows, plan: str = "auto", chunk_rows: int | None = None,
    max_steps: int = MAX_STEPS, step_rows: int = CHUNK_STEPS,
) -> ArimaModel:
    """Fit on all rows of each series, or on the newest ``max_rows``. Lags of a series too long for one task come from chunks. At most
    ``max_steps`` steps of conditional least squares (none: the two-stage estimates) run in chunks of ``step_rows`` rows."""
    (p, d, q), (sp, sd, sq, s) = ORDERS[name]
    if order:
        p, d, q = order
    if seasonal:
        sp, sd, sq, s = seasonal
    exog = list(exog) if name == "SARIMAX" else []
    ar, ma = expanded_lags(p, sp, s), expanded_lags(q, sq, s)
    weights = difference_weights(d, sd, s)
    rows = df.select(series, ts, F.col(target).cast("double").alias("_y"), *exog)
    if max_rows is not None:
        rows = tail(rows, max_rows, series=series, ts=ts)
    plan = choose_plan(rows, [series], plan)
    lagged = lambda frame, before, build: windowed(frame, series, ts, before, build, plan, chunk_rows)

    def differenced(c: str, w):
        return _weighted(c, weights, w)

    base = lagged(rows, max(weights), lambda w: {"_w": differenced("_y", w), **{f"_x_{c}": differenced(c, w) for c in exog}})
    long = sorted({*range(1, max(8, 2 * (p + q)) + 1), *([s - 1, s, s + 1, 2 * s, 2 * s + 1] if s else [])})
    stage1 = [f"_l{k}" for k in long]
    base = lagged(base, max(long), lambda w: {f"_l{k}": F.lag("_w", k).over(w) for k in long})
    usable = base.na.drop(subset=["_w", *stage1])
    first = solve(cross_products(usable, [*stage1, "_w"], series=series), len(stage1), series=series, intercept=False)
    first = reliable(first.select(series, F.col("coef").alias("long_coef")))
    base = base.join(first, series).withColumn("_e", F.col("_w") - dot(stage1, F.col("long_coef"))).drop("long_coef", *stage1)
    # The second regression reads the innovations twice.
    base = reliable(base)
    if ar or ma:
        base = lagged(base, max([*ar, *ma]), lambda w: {f"_a{k}": F.lag("_w", k).over(w) for k in ar} | {f"_m{k}": F.lag("_e", k).over(w) for k in ma})
    cols = [*[f"_a{k}" for k in ar], *[f"_m{k}" for k in ma], *[f"_x_{c}" for c in exog]]
    if cols:
        second = base.na.drop(subset=["_w", *cols])
        table = solve(cross_products(second, [*cols, "_w"], series=series), len(cols), series=series, intercept=False)
        table = reliable(table.join(first, series))
        if max_steps and (ma or (p and sp)):
            factors = Factors((p, d, q), (sp, sd, sq, s), ar, ma, len(exog))
            used = ["_w", *[f"_a{k}" for k in ar], *[f"_x_{c}" for c in exog]]
            tied = refine(base.na.drop(subset=used), table, factors, used, series=series, ts=ts, chunk_rows=step_rows, max_steps=max_steps)
            table = reliable(table.drop("coef").join(tied.select(series, "coef"), series))
    else:  # differences alone: nothing to estimate
        table = reliable(first.withColumn("coef", F.array().cast("array<double>")))
    state = reliable(_recent(rows.withColumnRenamed("_y", target), target, exog, _reach(ar, ma, long, weights), series, ts))
    return ArimaModel(name, table, state, ar, ma, long, weights, exog, series, ts, target)
