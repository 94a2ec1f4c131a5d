"""Isolation forest and local outlier factor scores per series, and a coarse one-class direction.

Both score every row. Fitting works on bounded groups: a forest samples 256 rows per tree and
neighbours are searched leaf by leaf. No rule depends on the size of a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.calendar import epoch_us
from wattline.operators.neighbours import LEAF_ROWS, knn

SUBSAMPLE = 256
# Rows that a tree draws before it keeps SUBSAMPLE of them; fewer than that have a chance of 1e-9.
DRAWN = SUBSAMPLE + 6 * 16
SCORE_BUCKET_ROWS = 50_000
FOURIER_FEATURES = 256
FIT_STEPS = 300
EULER = 0.5772156649015329


def bucketed(x: DataFrame, rows: int, *, series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Spread each series over ``ceil(n / rows)`` hash buckets."""
    sizes = x.groupBy(series).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_buckets"))
    return x.join(sizes, series).withColumn("bucket", F.pmod(F.xxhash64(ts), F.col("_buckets"))).drop("_buckets")


def per_bucket(rows: DataFrame, model: DataFrame, series: str) -> DataFrame:
    """Copy each series' model rows to every bucket the series has. Keys get names of their
    own, since both sides of the cogroup come from the same rows."""
    return model.join(rows.select(series, "bucket").distinct(), series).withColumnsRenamed(
        {series: "_series", "bucket": "_bucket"}
    )


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random splits down to single points or the height limit, as parallel node lists."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    tree = {"feature": [], "threshold": [], "left": [], "right": [], "depth": []}
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(tree["feature"])
        if parent is not None:
            tree[side][parent] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or not len(usable)
        f = -1 if leaf else int(rng.choice(usable))
        # below the largest value, so that both sides keep a row
        cut = 0.0 if leaf else float(min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f])))
        for name, value in (("feature", f), ("threshold", cut), ("left", node), ("right", node),
                            ("depth", depth + path_constant(len(rows)) if leaf else 0.0)):
            tree[name].append(value)
        if not leaf:
            goes_left = x[rows, f] <= cut
            todo.append((rows[goes_left], depth + 1, node, "left"))
            todo.append((rows[~goes_left], depth + 1, node, "right"))
    return tree


def isolation_scores(
    x: DataFrame, *, trees: int = 100, seed: int = 42, series: str = "series_id", ts: str = "ts"
) -> DataFrame:
    """``(series, ts, score)``; higher is more isolated.

    Sampling and split draws are seeded by series and tree, not by partition."""
    sizes = x.groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    top = 1 << 30
    share = F.least(F.lit(1.0), F.lit(float(DRAWN)) / F.col("_n")) * top
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    # a row is copied for the trees that draw it only: about DRAWN * trees copies per series at any size
    taken = F.filter(every, lambda t: F.pmod(F.xxhash64(F.lit(seed + 1), series, t, ts), F.lit(top)) < F.col("_share"))
    drawn = x.join(sizes, series).withColumn("_share", share).withColumn("tree", F.explode(taken)).drop("_n", "_share")
    drawn = drawn.repartition(series, "tree")
    wt = Window.partitionBy(series, "tree").orderBy(F.xxhash64(F.lit(seed), series, "tree", ts), ts)
    drawn = drawn.withColumn("_rn", F.row_number().over(wt)).filter(F.col("_rn") <= SUBSAMPLE)
    drawn = drawn.select(series, "tree", "_rn", "x")
    schema = T.StructType([
        x.schema[series], T.StructField("tree", T.IntegerType()), T.StructField("sample", T.IntegerType()),
        T.StructField("feature", T.ArrayType(T.IntegerType())), T.StructField("threshold", T.ArrayType(T.DoubleType())),
        T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType())),
        T.StructField("depth", T.ArrayType(T.DoubleType())),
    ])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        sid, tree = pdf[series].iloc[0], int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree, *str(sid).encode()])
        grown = grow_tree(np.stack(pdf["x"].to_numpy()), rng)
        return pd.DataFrame({series: [sid], "tree": [tree], "sample": [len(pdf)], **{n: [v] for n, v in grown.items()}})

    forest = drawn.groupBy(series, "tree").applyInPandas(build, schema)
    rows = bucketed(x.select(series, ts, "x"), SCORE_BUCKET_ROWS, series=series, ts=ts)
    out_schema = T.StructType([x.schema[series], x.schema[ts], T.StructField("score", T.DoubleType())])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(left["x"].to_numpy())
        total = np.zeros(len(points))
        for tree in right.itertuples(index=False):
            feature, cut = np.asarray(tree.feature), np.asarray(tree.threshold)
            sides = np.asarray(tree.right), np.asarray(tree.left)
            at = np.zeros(len(points), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = points[np.arange(len(points)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(below, sides[1][at], sides[0][at]), at)
            total += np.asarray(tree.depth)[at]
        mean = total / len(right)
        scale = path_constant(float(right["sample"].iloc[0])) or 1.0
        return left[[series, ts]].assign(score=2.0 ** (-mean / scale))

    return (
        rows.groupBy(series, "bucket").cogroup(per_bucket(rows, forest, series).groupBy("_series", "_bucket"))
        .applyInPandas(score, out_schema)
    )


def lof_scores(
    x: DataFrame, dims: int, *, neighbors: int = 20, series: str = "series_id", ts: str = "ts",
    leaf_rows: int = LEAF_ROWS, plan: str = "auto",
) -> DataFrame:
    """``(series, ts, lof)`` from exact neighbours. Needs unique times per series."""
    ided = x.withColumn("id", epoch_us(ts))
    graph = knn(ided, neighbors, dims, series=series, leaf_rows=leaf_rows, plan=plan)
    edges = graph.select(series, "id", F.explode("near").alias("e")).select(series, "id", "e.dist", "e.nbr")
    kdist = graph.select(series, F.col("id").alias("nbr"), F.array_max(F.col("near")["dist"]).alias("_kd"))
    reach = edges.join(kdist, [series, "nbr"]).select(
        series, "id", "nbr", F.greatest("dist", "_kd").alias("_reach")
    )
    density = reach.groupBy(series, "id").agg((1.0 / (F.avg("_reach") + 1e-10)).alias("lrd"))
    around = (
        edges.select(series, "id", "nbr").join(density.withColumnRenamed("id", "nbr"), [series, "nbr"])
        .groupBy(series, "id").agg(F.avg("lrd").alias("_near"))
    )
    kind = dict(x.dtypes)[ts]
    at = F.timestamp_micros("id").cast(kind)
    scored = around.join(density, [series, "id"]).select(series, at.alias(ts), (F.col("_near") / F.col("lrd")).alias("lof"))
    # a row without neighbours is as dense as its surroundings
    return x.select(series, ts).join(scored, [series, ts], "left").withColumn("lof", F.coalesce("lof", F.lit(1.0)))


def fourier_map(dims: int, gamma: float, seed: int, features: int = FOURIER_FEATURES):
    """Random features whose inner products approximate exp(-gamma |a - b|^2)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dims, features))
    shift = rng.uniform(0.0, 2.0 * math.pi, size=features)

    def apply(x: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / features) * np.cos(x @ weights + shift)

    return apply


def one_class_direction(phi: np.ndarray, nu: float, steps: int = FIT_STEPS) -> np.ndarray:
    """Minimise |w|^2 / 2 - rho + mean(max(0, rho - phi w)) / nu by conditional gradient on the
    dual: every step mixes in the mean of the share ``nu`` of rows with the lowest response."""
    n = max(1, int(math.ceil(nu * len(phi))))
    w = phi.mean(axis=0)
    for _ in range(steps):
        lowest = np.argpartition(phi @ w, n - 1)[:n]
        step = phi[lowest].mean(axis=0) - w
        norm = float(step @ step)
        gain = -float(w @ step)
        if norm <= 1e-18 or gain <= 1e-10:
            break
        w = w + min(1.0, gain / norm) * step
    return w


def flag_top_share(
    scores: DataFrame, share: float, name: str, *, value: str, series: str = "series_id", ts: str = "ts", plan: str = "plain"
) -> DataFrame:
    """1 for scores strictly over the ``1 - share`` quantile of their series."""
    from wattline.operators.ordering import quantiles

    cut = quantiles(scores, value, {"_cut": 1.0 - share}, keys=[series], plan=plan)
    return scores.join(cut, series).select(series, ts, (F.col(value) > F.col("_cut")).cast("int").alias(name))


def used_exog(df: DataFrame, exog: Sequence[str]) -> list[str]:
    return [c for c in exog if c in df.columns]
