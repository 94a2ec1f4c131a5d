"""Conditional least squares of multiplicative seasonal models.

The innovations of a model follow from its differences one after the other, starting from zeros. Gauss-Newton
steps with damping lower their squares over the factors, so that every cross lag stays the product of its two
factors. A series of up to a chunk of rows is fitted in one task. Longer ones are cut into chunks: innovations
are linear in those before a chunk, so a power of one matrix carries them from chunk to chunk, and squares and
cross products are summed; each step is a job over all chunks of all long series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.ordering import positions
from wattline.session import reliable

MAX_STEPS = 50
# Steps end when the squares fall by a smaller share than this, or the damping is over its limit.
LEAST_GAIN, MOST_DAMPING = 1e-11, 1e8
_FARTHEST_ROOT = 0.9999


class Factors:
    """Parameters in the order: short and seasonal autoregression, short and seasonal moving average, exogenous."""

    def __init__(self, order: Sequence[int], seasonal: Sequence[int], ar: Sequence[int], ma: Sequence[int], n_exog: int) -> None:
        (self.p, _, self.q), (self.sp, _, self.sq, self.s) = order, seasonal
        self.ar, self.ma, self.n_exog = list(ar), list(ma), n_exog
        self.top = max([0, *ma])
        self.cuts = np.cumsum([self.p, self.sp, self.q, self.sq])

    def split(self, params: np.ndarray) -> list[np.ndarray]:
        return np.split(np.asarray(params, dtype=float), self.cuts)

    def _product(self, short: np.ndarray, long: np.ndarray) -> np.ndarray:
        spaced = np.zeros(1 + self.s * len(long))
        spaced[0] = 1.0
        if len(long):
            spaced[self.s::self.s] = long
        return np.convolve(np.concatenate([[1.0], short]), spaced)

    def expanded(self, params: np.ndarray) -> np.ndarray:
        """Coefficients of the lags of differences, of innovations, and of exogenous columns."""
        a, sa, m, sm, b = self.split(params)
        return np.concatenate([-self._product(-a, -sa)[self.ar], self._product(m, sm)[self.ma], b]) if self.ar or self.ma else b

    def invertible(self, params: np.ndarray) -> bool:
        _, _, m, sm, _ = self.split(params)
        return all(np.isfinite(f).all() and (not len(f) or np.abs(np.roots([1.0, *f])).max(initial=0.0) < _FARTHEST_ROOT) for f in (m, sm))

    def start(self, coef: np.ndarray) -> np.ndarray:
        """Factors from free coefficients, with moving averages drawn in until they are invertible."""
        of = dict(zip([("a", k) for k in self.ar] + [("m", k) for k in self.ma], coef, strict=False))
        read = lambda kind, n, step: [float(of.get((kind, step * k), 0.0)) for k in range(1, n + 1)]
        b = [float(v) for v in coef[len(self.ar) + len(self.ma):]]
        params = np.array([*read("a", self.p, 1), *read("a", self.sp, self.s), *read("m", self.q, 1), *read("m", self.sq, self.s), *b])
        params = np.nan_to_num(params)
        while not self.invertible(params):
            params[self.cuts[1]:self.cuts[3]] *= 0.8
        return params

    def beside(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients at the parameters and at both sides of each one, and the distances."""
        apart = 1e-5 * np.maximum(1.0, np.abs(params))
        moved = [params, *(params + sign * d for d in np.diag(apart) for sign in (1.0, -1.0))]
        return np.stack([self.expanded(m) for m in moved]), apart

    def innovations(self, rows: np.ndarray, coefs: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Innovations (rows x sets) after those ``before`` (oldest first). ``rows`` hold a difference, its lags and exogenous ones."""
        n_ar, n_ma, ma = len(self.ar), len(self.ma), np.array(self.ma, dtype=int)
        fixed = np.delete(coefs, np.s_[n_ar:n_ar + n_ma], axis=1)
        given = rows[:, :1] - rows[:, 1:] @ fixed.T
        if not n_ma:
            return given
        top, lagged = self.top, np.ascontiguousarray(coefs[:, n_ar:n_ar + n_ma].T)
        out = np.concatenate([before, given])
        with np.errstate(over="ignore", invalid="ignore"):
            for t in range(top, len(out)):
                out[t] -= (lagged * out[t - ma]).sum(axis=0)
        return out[top:]

    def powers(self, coefs: np.ndarray, steps: int) -> list[np.ndarray]:
        """For every set, the map of the innovations before a chunk to those at its end, its own rows aside."""
        out = []
        for c in coefs[:, len(self.ar):len(self.ar) + len(self.ma)]:
            one = np.eye(self.top, k=1)
            one[-1, self.top - np.array(self.ma, dtype=int)] = -c
            out.append(np.linalg.matrix_power(one, steps))
        return out

    @staticmethod
    def products(e: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Squares, slopes times innovations and slopes times slopes, in one array."""
        with np.errstate(over="ignore", invalid="ignore"):
            slopes = (e[:, 1::2] - e[:, 2::2]) / (2.0 * apart)
            return np.concatenate([[e[:, 0] @ e[:, 0]], slopes.T @ e[:, 0], (slopes.T @ slopes).ravel()])


def begin(params: np.ndarray) -> dict:
    """State of a fit: the best parameters with their products (none yet), and those to try next."""
    return {"best": params, "sums": np.zeros(0), "damping": 1e-4, "trial": params, "done": len(params) == 0}


def advance(factors: Factors, state: dict, sums: np.ndarray) -> dict:
    """State after the trial had the ``sums`` of ``Factors.products``."""
    best, held, damping, trial = state["best"], state["sums"], state["damping"], state["trial"]
    better = np.isfinite(sums).all() and (not len(held) or sums[0] < held[0])
    done = False
    if better:
        done = len(held) > 0 and held[0] - sums[0] <= LEAST_GAIN * held[0]
        best, damping, held = trial, damping / 10 if len(held) else damping, sums
    elif not len(held):  # not even the start is finite: it stays
        return {**state, "done": True}
    else:
        damping *= 10
    k = len(best)
    slopes, squares = held[1:k + 1], held[k + 1:].reshape(k, k)
    scale = np.where(np.diag(squares) > 0, np.diag(squares), 1.0)
    step = np.linalg.lstsq(squares + damping * np.diag(scale), slopes, rcond=None)[0]
    while not factors.invertible(best - step):
        step = step / 2
    return {"best": best, "sums": held, "damping": damping, "trial": best - step, "done": bool(done or damping > MOST_DAMPING)}


def fit_rows(factors: Factors, rows: np.ndarray, start: np.ndarray, max_steps: int = MAX_STEPS) -> np.ndarray:
    """Parameters of least squares for rows that one task holds."""
    state = begin(start)
    for _ in range(max_steps):
        if state["done"]:
            break
        coefs, apart = factors.beside(state["trial"])
        e = factors.innovations(rows, coefs, np.zeros((factors.top, len(coefs))))
        state = advance(factors, state, factors.products(e, apart))
    return state["best"]


def refine(
    rows: DataFrame, table: DataFrame, factors: Factors, columns: Sequence[str], *, series: str, ts: str, chunk_rows: int, max_steps: int = MAX_STEPS,
) -> DataFrame:
    """``(series, factors, coef)``: least squares from the free coefficients of ``table``. ``columns`` are the difference, its lags
    and exogenous columns, none null. Without rows a series has the factors that its coefficients give."""
    rows = rows.select(series, ts, *columns)
    sizes = rows.groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    long = reliable(sizes.filter(F.col("_n") > chunk_rows).select(series))
    numbers = T.ArrayType(T.DoubleType())
    own = table.select(F.col(series).alias("_series"), "coef")
    out_schema = T.StructType([rows.schema[series], T.StructField("factors", numbers), T.StructField("coef", numbers)])

    def told(sid, params: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({series: [sid], "factors": [params.tolist()], "coef": [factors.expanded(params).tolist()]})

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({series: [], "factors": [], "coef": []})
        start = factors.start(np.asarray(right["coef"].iloc[0], dtype=float))
        values = left.sort_values(ts, kind="stable")[list(columns)].to_numpy(dtype=float)
        return told(right["_series"].iloc[0], fit_rows(factors, values, start, max_steps) if len(values) else start)

    short = rows.join(long, series, "left_anti")
    few = own.join(long.withColumnRenamed(series, "_series"), "_series", "left_anti")
    fitted = short.groupBy(series).cogroup(few.groupBy("_series")).applyInPandas(whole, out_schema)
    if long.isEmpty():
        return reliable(fitted)
    return reliable(fitted.unionByName(_refine_long(rows.join(long, series, "left_semi"), own, factors, columns, told, out_schema, series, ts, chunk_rows, max_steps)))


def _refine_long(rows, own, factors, columns, told, out_schema, series, ts, chunk_rows, max_steps):
    placed = positions(rows, [series], [ts], pos="_pos", plan="chunked")
    placed = reliable(placed.withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows)))
    chunks = reliable(placed.groupBy(series, "_chunk").agg(F.count(F.lit(1)).alias("size")))
    numbers, sid = T.ArrayType(T.DoubleType()), T.StructField("_series", rows.schema[series].dataType)
    state_schema = T.StructType([sid, *[T.StructField(c, numbers) for c in ("best", "sums", "trial")],
                                 T.StructField("damping", T.DoubleType()), T.StructField("done", T.BooleanType())])

    def row_of(sid, state: dict) -> pd.DataFrame:
        return pd.DataFrame({"_series": [sid], **{c: [np.asarray(state[c]).tolist()] for c in ("best", "sums", "trial")},
                             "damping": [float(state["damping"])], "done": [bool(state["done"])]})

    def state_of(pdf: pd.DataFrame) -> dict:
        r = pdf.iloc[0]
        return {**{c: np.asarray(r[c], dtype=float) for c in ("best", "sums", "trial")}, "damping": r["damping"], "done": r["done"]}

    def started(pdf: pd.DataFrame) -> pd.DataFrame:
        return row_of(pdf["_series"].iloc[0], begin(factors.start(np.asarray(pdf["coef"].iloc[0], dtype=float))))

    def values_of(left: pd.DataFrame) -> np.ndarray:
        return left.sort_values("_pos")[list(columns)].to_numpy(dtype=float)

    end_schema = T.StructType([rows.schema[series], T.StructField("_chunk", T.LongType()), T.StructField("size", T.LongType()), T.StructField("end", numbers)])
    start_schema = T.StructType([sid, T.StructField("_at", T.LongType()), T.StructField("before", numbers), T.StructField("trial", numbers)])
    sum_schema = T.StructType([rows.schema[series], T.StructField("sums", numbers)])

    def ended(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in end_schema})
        coefs, _ = factors.beside(np.asarray(right["trial"].iloc[0], dtype=float))
        e = factors.innovations(values_of(left), coefs, np.zeros((factors.top, len(coefs))))
        last = np.concatenate([np.zeros((factors.top, len(coefs))), e])[len(e):]
        return pd.DataFrame({series: [left[series].iloc[0]], "_chunk": [left["_chunk"].iloc[0]], "size": [len(left)], "end": [last.ravel().tolist()]})

    def carried(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            trial = right["trial"].iloc[0]
            coefs, _ = factors.beside(np.asarray(trial, dtype=float))
            before, powers = np.zeros((factors.top, len(coefs))), {}
            for r in left.sort_values("_chunk").itertuples(index=False):
                out.append((r[0], r[1], before.ravel().tolist(), trial))
                if r.size not in powers:
                    powers[r.size] = factors.powers(coefs, int(r.size)) if factors.top else []
                moved = [m @ before[:, k] for k, m in enumerate(powers[r.size])]
                before = np.asarray(r.end, dtype=float).reshape(before.shape) + (np.stack(moved, axis=1) if moved else 0.0)
        return pd.DataFrame(out, columns=["_series", "_at", "before", "trial"])

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in sum_schema})
        coefs, apart = factors.beside(np.asarray(right["trial"].iloc[0], dtype=float))
        e = factors.innovations(values_of(left), coefs, np.asarray(right["before"].iloc[0], dtype=float).reshape(factors.top, len(coefs)))
        return pd.DataFrame({series: [left[series].iloc[0]], "sums": [factors.products(e, apart).tolist()]})

    def stepped(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({f.name: [] for f in state_schema})
        state = state_of(right)
        return row_of(right["_series"].iloc[0], advance(factors, state, np.sum(np.stack(left["sums"].to_numpy()), axis=0)) if len(left) else state)

    mine = own.join(chunks.select(F.col(series).alias("_series")).distinct(), "_series")
    states = reliable(mine.groupBy("_series").applyInPandas(started, state_schema))
    for _ in range(max_steps):
        open_states = states.filter("not done")
        if open_states.isEmpty():
            break
        trials = open_states.select("_series", "trial")
        at = chunks.join(trials, F.col(series) == F.col("_series")).select("_series", F.col("_chunk").alias("_at"), "trial")
        ends = placed.groupBy(series, "_chunk").cogroup(at.groupBy("_series", "_at")).applyInPandas(ended, end_schema)
        starts = ends.groupBy(series).cogroup(trials.groupBy("_series")).applyInPandas(carried, start_schema)
        parts = placed.groupBy(series, "_chunk").cogroup(starts.groupBy("_series", "_at")).applyInPandas(summed, sum_schema)
        states = reliable(parts.groupBy(series).cogroup(states.groupBy("_series")).applyInPandas(stepped, state_schema))

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        return told(pdf["_series"].iloc[0], np.asarray(pdf["best"].iloc[0], dtype=float))

    return states.groupBy("_series").applyInPandas(finished, out_schema)
