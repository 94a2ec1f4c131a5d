"""One-class support vector machine with an RBF kernel, one per series.

The dual of a series of up to ``SOLVE_ROWS`` rows is solved in one task. Longer series are cut into buckets
that are solved by themselves and merged in rounds by their support vectors; then rows that the merged
machine misplaces join its support vectors until there are none, so the result is that of all rows at once.
A series whose support vectors alone (a share ``nu`` of its rows at least) pass ``SOLVE_ROWS`` keeps several
machines, whose sum scores through random Fourier features; no task holds more in either form.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.outlier_models import bucketed, fourier_map, one_class_direction, per_bucket
from wattline.session import reliable

# Rows of a series that one task solves, and what it remembers of their kernel.
SOLVE_ROWS = 8192
KERNEL_BYTES = 128 << 20
# The largest difference of responses that the conditions of the optimum may be off by, weights being 0 to 1.
TOLERANCE = 1e-3
_BLOCK = 512


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.exp(-gamma * np.maximum(apart, 0.0))


def responses(points: np.ndarray, x: np.ndarray, weight: np.ndarray, gamma: float) -> np.ndarray:
    """Sum of the weighted kernels of ``x`` at every point."""
    out = np.zeros(len(points))
    for k in range(0, len(x), _BLOCK):
        out += rbf(points, x[k:k + _BLOCK], gamma) @ weight[k:k + _BLOCK]
    return out


def solve_dual(x: np.ndarray, weight: np.ndarray, gamma: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights from 0 to 1 with the sum of those given that minimise the weighted kernel sum, and the threshold rho.

    A step moves weight between two rows: to the one of least response, from the one that gains most by the second order."""
    weight, n = weight.astype(float), len(x)
    held = np.flatnonzero(weight)
    response = responses(x, x[held], weight[held], gamma)
    columns, limit = {}, max(2, KERNEL_BYTES // (8 * n))

    def column(k: int) -> np.ndarray:
        if k not in columns:
            if len(columns) >= limit:
                columns.clear()
            columns[k] = rbf(x, x[k:k + 1], gamma)[:, 0]
        return columns[k]

    while True:
        rising, falling = weight < 1.0, weight > 0.0
        if not rising.any() or not falling.any():
            break
        i = int(np.argmin(np.where(rising, response, np.inf)))
        gap = np.where(falling, response - response[i], 0.0)
        if gap.max() < tolerance:
            break
        near = column(i)
        curve = np.maximum(2.0 - 2.0 * near, 1e-12)
        j = int(np.argmax(np.where(gap > 0, gap * gap / curve, 0.0)))
        step = gap[j] / curve[j]
        full, void = step >= 1.0 - weight[i], step >= weight[j]
        step = min(step, 1.0 - weight[i], weight[j])
        weight[i] = 1.0 if full and step == 1.0 - weight[i] else weight[i] + step
        weight[j] = 0.0 if void and step == weight[j] else weight[j] - step
        response += step * (near - column(j))
    free = (weight > 0) & (weight < 1)
    if free.any():
        return weight, float(response[free].mean())
    sides = [response[weight > 0].max()] if (weight > 0).any() else []
    return weight, float(np.mean(sides + ([response[weight < 1].min()] if (weight < 1).any() else [])))


def _begin(x: np.ndarray, nu: float, gamma: float, dims: int, seed: int) -> np.ndarray:
    """A start of the right sum: the rows that a coarse direction puts outside."""
    phi = fourier_map(dims, gamma, seed)(x)
    order = np.argsort(phi @ one_class_direction(phi, nu), kind="stable")
    mass = nu * len(x)
    weight = np.zeros(len(x))
    whole = min(len(x), int(math.floor(mass)))
    weight[order[:whole]] = 1.0
    if whole < len(x):
        weight[order[whole]] = mass - whole
    return weight


def fit_one_class(
    x: DataFrame, dims: int, *, nu: float = 0.05, seed: int = 42, series: str = "series_id", ts: str = "ts", solve_rows: int = SOLVE_ROWS,
) -> DataFrame:
    """Support vectors ``(series, part, n, ts, x, weight, rho)`` of rows ``(series, ts, x)``. Weights are from 0 to 1 and have the
    sum ``nu * n``, where ``n`` counts the rows of the part; a series has one part unless its support vectors pass ``solve_rows``."""
    gamma = 1.0 / dims
    rows = bucketed(x.select(series, ts, "x"), solve_rows, series=series, ts=ts)
    schema = T.StructType([
        x.schema[series], T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), x.schema[ts],
        T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("weight", T.DoubleType()), T.StructField("rho", T.DoubleType()),
    ])

    def vectors(pdf: pd.DataFrame, part: int, n: int, weight: np.ndarray, rho: float) -> pd.DataFrame:
        own = weight > 0
        return pdf.loc[own, [series, ts, "x"]].assign(part=part, n=n, weight=weight[own], rho=rho)[[f.name for f in schema]]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
        points = np.stack(pdf["x"].to_numpy())
        weight, rho = solve_dual(points, _begin(points, nu, gamma, dims, seed), gamma)
        return vectors(pdf, int(pdf["bucket"].iloc[0]), len(pdf), weight, rho)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
        if pdf["part"].nunique() == 1:
            return pdf.assign(part=pdf["_to"])[[f.name for f in schema]]
        weight, rho = solve_dual(np.stack(pdf["x"].to_numpy()), pdf["weight"].to_numpy(), gamma)
        return vectors(pdf, int(pdf["_to"].iloc[0]), int(pdf.groupby("part")["n"].first().sum()), weight, rho)

    machines = reliable(rows.groupBy(series, "bucket").applyInPandas(first, schema))
    if _single(machines):
        return machines
    several = machines.groupBy(series).agg(F.max("part").alias("_last")).filter("_last > 0").select(series)
    while True:
        parts = machines.groupBy(series, "part").agg(F.count(F.lit(1)).alias("_held"))
        shape = parts.groupBy(series).agg(F.count(F.lit(1)).alias("_parts"), F.floor(F.lit(solve_rows) / F.max("_held")).alias("_fan"))
        if shape.filter("_parts > 1 and _fan > 1").isEmpty():
            break
        to = F.when((F.col("_parts") > 1) & (F.col("_fan") > 1), F.floor(F.col("part") / F.col("_fan"))).otherwise(F.col("part"))
        merged = machines.join(shape, series).withColumn("_to", to).drop("_parts", "_fan")
        machines = reliable(merged.groupBy(series, "_to").applyInPandas(again, schema))
    whole = machines.groupBy(series).agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a = _b").select(series)
    cut = reliable(several.join(whole, series))
    while not cut.isEmpty():
        machines, cut = _mended(machines, rows.join(cut, series, "left_semi"), gamma, solve_rows, schema, series, ts)
    return machines


def _single(machines: DataFrame) -> bool:
    """No series has several machines."""
    return not machines.agg(F.max("part")).first()[0]


def _mended(machines, rows, gamma, solve_rows, schema, series, ts):
    """Machines whose worst misplaced rows were added and solved, and the series that had such rows."""
    left_schema = T.StructType([schema[series], schema[ts], schema["x"], T.StructField("_short", T.DoubleType())])

    def misplaced(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left.head(0).assign(_short=0.0)[[f.name for f in left_schema]]
        own = set(right["_at"])
        out = left[[t not in own for t in left[ts]]]
        points = np.stack(out["x"].to_numpy()) if len(out) else np.zeros((0, 1))
        short = right["rho"].iloc[0] - responses(points, np.stack(right["x"].to_numpy()), right["weight"].to_numpy(), gamma) if len(out) else []
        out = out.assign(_short=np.asarray(short, dtype=float))
        return out.loc[out["_short"] > 2 * TOLERANCE, [f.name for f in left_schema]]

    held = machines.groupBy(series).agg(F.count(F.lit(1)).alias("_held"))
    model = per_bucket(rows, machines.select(series, F.col(ts).alias("_at"), "x", "weight", "rho"), series)
    found = rows.groupBy(series, "bucket").cogroup(model.groupBy("_series", "_bucket")).applyInPandas(misplaced, left_schema)
    # the worst first; the others come in a later round, and a round has room for one at least
    rank = Window.partitionBy(series).orderBy(F.desc("_short"), ts)
    room = F.greatest(F.lit(1), F.least(F.lit(solve_rows // 4), F.lit(solve_rows) - F.col("_held")))
    found = found.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= solve_rows // 4)
    found = reliable(found.join(held, series).filter(F.col("_rank") <= room).select(series, ts, "x"))
    touched = reliable(found.select(series).distinct())

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable").reset_index(drop=True)
        weight, rho = solve_dual(np.stack(pdf["x"].to_numpy()), pdf["weight"].to_numpy(), gamma)
        keep = weight > 0
        return pdf.loc[keep].assign(n=int(pdf["n"].max()), weight=weight[keep], rho=rho)[[f.name for f in schema]]

    zero = F.lit(0).cast("long")
    new = found.select(series, zero.alias("part"), zero.alias("n"), ts, "x", F.lit(0.0).alias("weight"), F.lit(0.0).alias("rho"))
    again = machines.join(touched, series, "left_semi").unionByName(new).groupBy(series).applyInPandas(solved, schema)
    return reliable(machines.join(touched, series, "left_anti").unionByName(again)), touched


def one_class_scores(
    x: DataFrame, dims: int, *, nu: float = 0.05, seed: int = 42, series: str = "series_id", ts: str = "ts", solve_rows: int = SOLVE_ROWS,
) -> DataFrame:
    """``(series, ts, score)``, higher further outside: the threshold less the response, as a share of the weight of all rows.
    Series of several machines are scored by the sum of their responses, without a threshold."""
    gamma = 1.0 / dims
    machines = fit_one_class(x, dims, nu=nu, seed=seed, series=series, ts=ts, solve_rows=solve_rows)
    rows = bucketed(x.select(series, ts, "x"), solve_rows, series=series, ts=ts)
    out_schema = T.StructType([x.schema[series], x.schema[ts], T.StructField("score", T.DoubleType())])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[[series, ts]].head(0).assign(score=0.0)
        points, weight = np.stack(left["x"].to_numpy()), right["weight"].to_numpy()
        got = responses(points, np.stack(right["x"].to_numpy()), weight, gamma)
        return left[[series, ts]].assign(score=(right["rho"].iloc[0] - got) / weight.sum())

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        w = fourier_map(dims, gamma, seed)(np.stack(pdf["x"].to_numpy())).T @ pdf["weight"].to_numpy()
        return pd.DataFrame({series: [pdf[series].iloc[0]], "n": [int(pdf["n"].iloc[0])], "w": [w.tolist()]})

    def coarse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[[series, ts]].head(0).assign(score=0.0)
        phi = fourier_map(dims, gamma, seed)(np.stack(left["x"].to_numpy()))
        return left[[series, ts]].assign(score=-(phi @ np.asarray(right["w"].iloc[0])))

    def scored(vectors: DataFrame) -> DataFrame:
        exact = per_bucket(rows, vectors.select(series, "x", "weight", "rho"), series)
        return rows.groupBy(series, "bucket").cogroup(exact.groupBy("_series", "_bucket")).applyInPandas(score, out_schema)

    if _single(machines):
        return scored(machines)
    wide = machines.groupBy(series).agg(F.min("part").alias("_a"), F.max("part").alias("_b")).filter("_a <> _b").select(series)
    one = scored(machines.join(wide, series, "left_anti"))
    fit_schema = T.StructType([x.schema[series], T.StructField("n", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    vectors = machines.join(wide, series, "left_semi").groupBy(series, "part").applyInPandas(added, fit_schema)
    slots = vectors.select(series, "n", F.posexplode("w").alias("slot", "v")).groupBy(series, "slot").agg((F.sum("v") / (nu * F.sum("n"))).alias("v"))
    summed = slots.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"]).alias("w"))
    many = rows.groupBy(series, "bucket").cogroup(per_bucket(rows, summed, series).groupBy("_series", "_bucket")).applyInPandas(coarse, out_schema)
    return one.unionByName(many)
