"""Feature attributions: linear, tree-path and kernel SHAP values and their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.config import DEFAULTS
from wattline.models.linear import LinearModel, fit_linear
from wattline.models.series_trees import SeriesTreeModel, nodes_of
from wattline.models.trees import TreeModel, TreeNodes
from wattline.operators.ordering import head
from wattline.operators.outlier_models import bucketed, per_bucket

# Background rows of the kernel method, drawn by hash from the whole series; a setting of the method.
KERNEL_BACKGROUND = 100
KERNEL_BUCKET_ROWS = 2_000


def _first(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else head(df, rows)


def _array(features: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in features])


def _long(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, phi array`` to ``keys, feature, shap``."""
    names = F.array(*[F.lit(c) for c in features])
    pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap"))).alias("e")
    return df.select(*keys, pair).select(*keys, F.col("e.feature").alias("feature"), F.col("e.shap").alias("shap"))


def background_means(df: DataFrame, features: Sequence[str], *, rows: int | None = DEFAULTS.background_rows) -> DataFrame:
    """Mean of each feature over the rows of a series (the first ``rows`` if given), as one array."""
    return _first(df, rows).groupBy("series_id").agg(F.array(*[F.avg(F.col(c).cast("double")) for c in features]).alias("_bg"))


def linear_shap(
    df: DataFrame, model: LinearModel, *, background: DataFrame | None = None,
    background_rows: int | None = DEFAULTS.background_rows, max_rows: int | None = DEFAULTS.explain_rows, compat: bool = False,
) -> DataFrame:
    """Coefficient times distance from the background mean, for all rows or the first ``max_rows``.

    ``compat`` applies the z-score coefficients to unscaled features."""
    sample = _first(df, max_rows)
    means = background_means(background if background is not None else df, model.features, rows=background_rows)
    coef = model.table.select("series_id", F.col("scaled_coef" if compat else "coef").alias("_c"))
    phi = F.zip_with(
        F.zip_with(_array(model.features), F.col("_bg"), lambda x, m: x - m), F.col("_c"), lambda d, c: d * c
    )
    rows = sample.join(means, "series_id").join(coef, "series_id").select("series_id", "ts", phi.alias("phi"))
    return _long(rows, model.features, ["series_id", "ts"])


class PathGames:
    """Shapley values of a tree ensemble from its root-to-leaf paths.

    Along one path the value of a feature set is a product: a feature in the set
    contributes 1 or 0 (does the row satisfy its interval), any other the share of training
    rows that go that way. The Shapley weights of such a product are an integral over [0, 1] of a
    polynomial, which Gauss-Legendre nodes evaluate exactly. Features a path does not
    use are padded with factor 1 and contribute nothing."""

    def __init__(self, nodes: TreeNodes, n_features: int) -> None:
        self.n = n_features
        self.base = 0.0
        self.trees = []
        for root, weight in zip(nodes.root, nodes.weight):
            paths = self._paths(nodes, int(root))
            width = max((len(p[0]) for p in paths), default=0) or 1
            shape = (len(paths), width)
            feature, low = np.zeros(shape, dtype=int), np.full(shape, -np.inf)
            high, share = np.full(shape, np.inf), np.ones(shape)
            value = np.zeros(len(paths))
            for i, (conditions, leaf) in enumerate(paths):
                value[i] = leaf * weight
                for j, (f, (lo, hi, w)) in enumerate(conditions.items()):
                    feature[i, j], low[i, j], high[i, j], share[i, j] = f, lo, hi, w
            self.base += float((value * share.prod(axis=1)).sum())
            points, weights = np.polynomial.legendre.leggauss(width // 2 + 1)
            self.trees.append((feature, low, high, share, value, (points + 1) / 2, weights / 2))

    @staticmethod
    def _paths(nodes: TreeNodes, root: int):
        out, todo = [], [(root, {})]
        while todo:
            at, seen = todo.pop()
            f = int(nodes.feature[at])
            if f < 0:
                out.append((seen, float(nodes.value[at])))
                continue
            cut = float(nodes.threshold[at])
            lo, hi, w = seen.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((nodes.left[at], (lo, min(hi, cut))), (nodes.right[at], (max(lo, cut), hi))):
                ratio = float(nodes.count[child] / nodes.count[at])
                todo.append((int(child), {**seen, f: (*bounds, w * ratio)}))
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), self.n))
        for feature, low, high, share, value, points, weights in self.trees:
            seen = x[:, feature]
            inside = ((seen > low) & (seen <= high)).astype(float)
            gain = np.zeros_like(inside)
            for t, wt in zip(points, weights):
                factor = share * (1 - t) + inside * t
                gain += wt * factor.prod(axis=2, keepdims=True) / factor
            gain *= (inside - share) * value[:, None]
            flat = gain.reshape(len(x), -1)
            onto = np.zeros((feature.size, self.n))
            onto[np.arange(feature.size), feature.ravel()] = 1.0
            phi += flat @ onto
        return phi


TREE_BATCH = 64
# Rows that one task attributes under the trees of a series.
SHAP_BUCKET_ROWS = 100


def _series_tree_shap(sample: DataFrame, model: SeriesTreeModel) -> DataFrame:
    """Each series' rows under its own trees, which every bucket of its rows gets once."""
    rows = bucketed(sample.select("series_id", "ts", _array(model.features).alias("_x")), SHAP_BUCKET_ROWS)
    n_features = len(model.features)
    schema = T.StructType([sample.schema["series_id"], sample.schema["ts"], T.StructField("base", T.DoubleType()), T.StructField("phi", T.ArrayType(T.DoubleType()))])

    def explain(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"series_id": [], "ts": left["ts"].head(0), "base": [], "phi": []})
        nodes, base = nodes_of(right.iloc[0])
        games, x = PathGames(nodes, n_features), np.stack(left["_x"].to_numpy())
        phi = np.concatenate([games.values(x[k:k + TREE_BATCH]) for k in range(0, len(x), TREE_BATCH)])
        return left[["series_id", "ts"]].assign(base=base + games.base, phi=list(phi))

    solved = rows.groupBy("series_id", "bucket").cogroup(per_bucket(rows, model.parameters(), "series_id").groupBy("_series", "_bucket")).applyInPandas(explain, schema)
    names = F.array(*[F.lit(c) for c in model.features])
    pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap"))).alias("e")
    return solved.select("series_id", "ts", "base", pair).select("series_id", "ts", "base", "e.feature", "e.shap")


def tree_shap(df: DataFrame, model: TreeModel | SeriesTreeModel, *, max_rows: int | None = DEFAULTS.explain_rows) -> DataFrame:
    """Path-dependent attributions; ``base`` plus a row's values is its prediction."""
    sample = _first(df, max_rows)
    if isinstance(model, SeriesTreeModel):
        return _series_tree_shap(sample, model)
    nodes = model.nodes()
    if (nodes.count <= 0).any():
        raise ValueError("ensemble without training counts")
    # The node arrays are shipped (their number is checked); paths are laid out in the tasks.
    shipped, n_features = SparkSession.getActiveSession().sparkContext.broadcast(nodes), len(model.features)
    schema = T.StructType([
        df.schema["series_id"], df.schema["ts"], T.StructField("base", T.DoubleType()),
        T.StructField("phi", T.ArrayType(T.DoubleType())),
    ])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        games = None
        for batch in batches:
            games = games or PathGames(shipped.value, n_features)
            for start in range(0, len(batch), TREE_BATCH):
                part = batch.iloc[start:start + TREE_BATCH]
                phi = games.values(np.stack(part["_x"].to_numpy()))
                yield part[["series_id", "ts"]].assign(base=games.base, phi=list(phi))

    # few rows and much work for each: spread them over the cluster first
    spread = sample.select("series_id", "ts", _array(model.features).alias("_x")).repartition("series_id", "ts")
    rows = spread.mapInPandas(explain, schema)
    names = F.array(*[F.lit(c) for c in model.features])
    pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap"))).alias("e")
    return rows.select("series_id", "ts", "base", pair).select("series_id", "ts", "base", "e.feature", "e.shap")


def coalitions(n_features: int, budget: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Masks and weights of the Shapley kernel: every one-feature set and complement, then
    random sets in complementary pairs up to ``budget``."""
    m = n_features
    if m == 1:  # the only feature takes the whole difference
        return np.zeros((0, 1), bool), np.zeros(0)
    rng = np.random.default_rng(seed)
    masks = [np.eye(m, dtype=bool)[i] for i in range(m)]
    masks += [~a for a in masks] if m > 2 else []
    single = (m - 1) / (m * 1.0 * (m - 1))
    weights = [single] * len(masks)
    sizes = np.arange(2, m - 1)
    if len(sizes) and budget > len(masks):
        kernel = (m - 1) / (sizes * (m - sizes))  # summed over all sets of a size
        share = kernel / kernel.sum()
        pairs = (budget - len(masks)) // 2
        for s in rng.choice(sizes, size=pairs, p=share):
            a = np.zeros(m, dtype=bool)
            a[rng.choice(m, size=int(s), replace=False)] = True
            masks += [a, ~a]
            weights += [kernel.sum() / (2 * pairs)] * 2
    return np.array(masks), np.array(weights, dtype=float)


def kernel_shap(
    df: DataFrame, model, *, background: DataFrame | None = None, background_rows: int = KERNEL_BACKGROUND,
    max_rows: int | None = DEFAULTS.explain_rows, budget: int = 512, seed: int = 42,
) -> DataFrame:
    """Model-agnostic attributions by weighted least squares over feature sets.

    The background is ``background_rows`` rows of each series, drawn by hash from all of it. Rows are
    spread over buckets; a task mixes them with sets and background in numpy blocks, scores the
    blocks and gives one solved row each, so nothing but rows is shuffled."""
    features = list(model.features)
    masks, weights = coalitions(len(features), budget, seed)
    m = len(features)
    sample = _first(df, max_rows).select("series_id", "ts", _array(features).alias("_x"))
    given = background if background is not None else df
    w = Window.partitionBy("series_id").orderBy(F.xxhash64(F.lit(seed), "series_id", "ts"), "ts")
    pool = given.select("series_id", "ts", _array(features).alias("_z")).withColumn("_rn", F.row_number().over(w))
    pool = pool.filter(F.col("_rn") <= background_rows).drop("ts")
    params = model.parameters()
    if params is not None:  # with the first background row only
        pool = pool.join(params.withColumn("_rn", F.lit(1)), ["series_id", "_rn"], "left")
    score = model.matrix_scorer()
    schema = T.StructType([
        df.schema["series_id"], df.schema["ts"], T.StructField("base", T.DoubleType()),
        T.StructField("phi", T.ArrayType(T.DoubleType())),
    ])
    # the last feature takes what is left, so the values add up exactly
    z = masks.astype(float)
    root = np.sqrt(weights)[:, None]
    solver = np.linalg.pinv((z[:, :-1] - z[:, [-1]]) * root) * root.T if m > 1 else np.zeros((0, 0))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x, own = np.stack(left["_x"].to_numpy()), right.sort_values("_rn")
        back, row = np.stack(own["_z"].to_numpy()), own.iloc[0]
        base, full = float(np.mean(score(back, row))), np.asarray(score(x, row), dtype=float)
        phi = np.empty((len(x), m))
        for start in range(0, len(x), 64):
            part = x[start:start + 64]
            values = np.empty((len(part), len(masks)))
            for k, mask in enumerate(masks):
                mixed = np.where(mask, part[:, None, :], back[None, :, :])
                values[:, k] = np.asarray(score(mixed.reshape(-1, m), row)).reshape(len(part), -1).mean(axis=1)
            gap = full[start:start + 64, None] - base
            solved = (values - base - z[:, -1] * gap) @ solver.T if m > 1 else np.zeros((len(part), 0))
            phi[start:start + 64] = np.hstack([solved, gap - solved.sum(axis=1, keepdims=True)])
        return left[["series_id", "ts"]].assign(base=base, phi=list(phi))

    rows = bucketed(sample, KERNEL_BUCKET_ROWS)
    solved = (
        rows.groupBy("series_id", "bucket").cogroup(per_bucket(rows, pool, "series_id").groupBy("_series", "_bucket"))
        .applyInPandas(solve, schema)
    )
    names = F.array(*[F.lit(c) for c in features])
    pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap"))).alias("e")
    return solved.select("series_id", "ts", "base", pair).select("series_id", "ts", "base", "e.feature", "e.shap")


def importance(shap: DataFrame) -> DataFrame:
    """Mean absolute attribution per series and feature."""
    return shap.groupBy("series_id", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def local_explanation(shap: DataFrame, at) -> DataFrame:
    """One row's attributions as a map; a row has as many entries as the model features."""
    rows = shap.filter(F.col("ts") == F.lit(at))
    return rows.groupBy("series_id", "ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "shap")))).alias("attributions")
    )


def explainer_kind(model) -> str:
    """Which explainer a model gets; a statistical or absent one is explained by a fresh
    linear model."""
    if model is None or model.statistical or isinstance(model, LinearModel):
        return "LinearExplainer"
    return "TreeExplainer" if model.name in ("RandomForest", "BoostedA") else "KernelExplainer"


def explain(df: DataFrame, model=None, *, features: Sequence[str] | None = None, max_rows: int | None = DEFAULTS.explain_rows, **kw) -> tuple[str, DataFrame]:
    """``(explainer kind, attributions)`` with the explainer chosen for the model."""
    kind = explainer_kind(model)
    if kind == "LinearExplainer":
        if not isinstance(model, LinearModel):
            model = fit_linear(df, features)
        return kind, linear_shap(df, model, max_rows=max_rows, **kw)
    if kind == "TreeExplainer":
        return kind, tree_shap(df, model, max_rows=max_rows)
    return kind, kernel_shap(df, model, max_rows=max_rows, **kw)
