"""Tree ensembles on MLlib: a random forest and two boosted configurations.

One ensemble is fitted over all series (MLlib grows trees from distributed histograms,
so a hot series is just more rows); metrics and selection stay per series.
MLlib's learners differ from other boosting libraries in split finding and
regularisation, so results agree in kind, not digit by digit.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.ordering import positions
from wattline.session import checkpoint_folder

SPARK_MAX_DEPTH = 30
MAX_MODEL_NODES = 5_000_000

# Default settings and search grids.
FOREST_DEFAULTS = {"trees": 100, "depth": 10, "min_leaf": 1, "min_split": 5}
FOREST_GRID = {"trees": [100, 200, 300], "depth": [10, 20, None], "min_split": [2, 5, 10], "min_leaf": [1, 2, 4]}
BOOSTED_A_DEFAULTS = {"trees": 200, "rate": 0.05, "depth": 6, "rows": 0.8, "columns": 0.8}
BOOSTED_A_GRID = {
    "trees": [100, 200, 300], "rate": [0.01, 0.05, 0.1], "depth": [4, 6, 8], "rows": [0.8, 1.0], "columns": [0.8, 1.0],
}
BOOSTED_B_DEFAULTS = {"trees": 200, "rate": 0.05, "depth": 6, "rows": 1.0, "columns": 1.0, "min_leaf": 20}
BOOSTED_B_TRIALS = 15


@dataclass
class TreeModel:
    """A fitted ensemble with its assembler."""

    name: str
    pipeline: PipelineModel
    features: list[str]
    statistical = False

    @property
    def ensemble(self):
        return self.pipeline.stages[-1]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scored = self.pipeline.transform(df).drop("features")
        return scored if out == "prediction" else scored.withColumnRenamed("prediction", out)

    def parameters(self) -> None:
        return None

    def panel_scorer(self):
        shipped = SparkSession.getActiveSession().sparkContext.broadcast(self.nodes())
        return lambda rows: shipped.value.predict

    def matrix_scorer(self):
        shipped = SparkSession.getActiveSession().sparkContext.broadcast(self.nodes())
        return lambda x, own: shipped.value.predict(x)

    def importances(self) -> list[tuple[str, float]]:
        """Impurity importances, summing to one."""
        return list(zip(self.features, map(float, self.ensemble.featureImportances.toArray())))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.name, self.features)], "name string, features array<string>").write.mode(
            "overwrite").parquet(f"{path}/info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        info = spark.read.parquet(f"{path}/info").first()
        return cls(info["name"], PipelineModel.load(f"{path}/pipeline"), list(info["features"]))

    def nodes(self) -> TreeNodes:
        """Node arrays of the ensemble, read from its saved node table. Their size is set by
        trees and depth, not by the data, and checked."""
        spark = SparkSession.getActiveSession()
        path = f"{checkpoint_folder(spark)}/trees-{uuid.uuid4().hex}"
        self.ensemble.save(path)
        table = spark.read.parquet(f"{path}/data")
        node = "nodeData"
        rows = table.select(
            "treeID", f"{node}.id", f"{node}.prediction", f"{node}.leftChild", f"{node}.rightChild",
            F.col(f"{node}.rawCount").cast("double").alias("count"), f"{node}.split.featureIndex",
            F.get(f"{node}.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        )
        if table.count() > MAX_MODEL_NODES:
            raise ValueError("ensemble too large to ship to tasks")
        pdf = rows.toPandas().sort_values(["treeID", "id"]).reset_index(drop=True)
        weights = np.asarray(self.ensemble.treeWeights, dtype=float)
        if "GBT" not in type(self.ensemble).__name__:
            weights = weights / weights.sum()
        return TreeNodes.build(pdf, weights)


@dataclass
class TreeNodes:
    """All trees in one set of arrays; a leaf points at itself."""

    root: np.ndarray
    weight: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, pdf, weights: np.ndarray) -> TreeNodes:
        tree = pdf["treeID"].to_numpy()
        root = np.searchsorted(tree, np.unique(tree))
        base = root[np.searchsorted(np.unique(tree), tree)]
        at = np.arange(len(pdf))
        inner = pdf["leftChild"].to_numpy() >= 0
        return cls(
            root, weights,
            np.where(inner, pdf["featureIndex"].to_numpy(), -1).astype(int),
            np.where(inner, pdf["threshold"].fillna(0.0).to_numpy(dtype=float), 0.0),
            np.where(inner, base + pdf["leftChild"].to_numpy(), at), np.where(inner, base + pdf["rightChild"].to_numpy(), at),
            pdf["prediction"].to_numpy(dtype=float), pdf["count"].to_numpy(dtype=float),
        )

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        at = np.tile(self.root, (len(x), 1))
        while (self.feature[at] >= 0).any():
            goes_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.value[at] @ self.weight


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _forest(params: dict, target: str, seed: int) -> RandomForestRegressor:
    depth = params["depth"] or SPARK_MAX_DEPTH
    return RandomForestRegressor(
        labelCol=target, featuresCol="features", numTrees=params["trees"], maxDepth=min(depth, SPARK_MAX_DEPTH),
        minInstancesPerNode=max(params["min_leaf"], params["min_split"] // 2), featureSubsetStrategy="all", seed=seed,
        maxBins=64, maxMemoryInMB=512,
    )


def _boosted(params: dict, target: str, seed: int, validation: str | None) -> GBTRegressor:
    columns = params["columns"]
    gbt = GBTRegressor(
        labelCol=target, featuresCol="features", maxIter=params["trees"], maxDepth=params["depth"],
        stepSize=params["rate"], subsamplingRate=params["rows"], minInstancesPerNode=params.get("min_leaf", 1),
        featureSubsetStrategy="all" if columns >= 1 else str(columns), seed=seed, maxBins=64, maxMemoryInMB=512,
    )
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def with_holdout(df: DataFrame, *, series: str = "series_id", ts: str = "ts", out: str = "_holdout") -> DataFrame:
    """Mark the last ``min(100, max(5, n // 10))`` rows per series; none under 20 rows."""
    ranked = positions(df, [series], [ts], pos="_i", total="_n")
    size = F.least(F.lit(100), F.greatest(F.lit(5), F.floor(F.col("_n") * F.lit(0.1))))
    mark = (F.col("_n") >= 20) & (F.col("_i") >= F.col("_n") - size)
    return ranked.withColumn(out, mark).drop("_i", "_n")


def with_folds(df: DataFrame, k: int = 3, *, series: str = "series_id", ts: str = "ts", out: str = "_fold") -> DataFrame:
    """Contiguous equal parts of every series."""
    ranked = positions(df, [series], [ts], pos="_i", total="_n")
    return ranked.withColumn(out, F.floor(F.col("_i") * k / F.col("_n")).cast("int")).drop("_i", "_n")


def draw(grid: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` distinct random grid points (all of them when the grid is smaller)."""
    rng = random.Random(seed)
    total = int(np.prod([len(v) for v in grid.values()]))
    picked: dict[tuple, dict] = {}
    while len(picked) < min(n, total):
        point = {k: rng.choice(v) for k, v in grid.items()}
        picked[tuple(point.values())] = point
    return list(picked.values())


def _param_map(estimator, p: dict) -> dict:
    """Our setting names as MLlib parameters of ``estimator``."""
    if isinstance(estimator, RandomForestRegressor):
        return {
            estimator.numTrees: p["trees"], estimator.maxDepth: min(p["depth"] or SPARK_MAX_DEPTH, SPARK_MAX_DEPTH),
            estimator.minInstancesPerNode: max(p["min_leaf"], p["min_split"] // 2),
        }
    return {
        estimator.maxIter: p["trees"], estimator.stepSize: p["rate"], estimator.maxDepth: p["depth"],
        estimator.subsamplingRate: p["rows"],
        estimator.featureSubsetStrategy: "all" if p["columns"] >= 1 else str(p["columns"]),
    }


def _search(train: DataFrame, estimator, candidates: list[dict], *, target: str, series: str, ts: str, parallelism: int):
    """Candidates compared by mean RMSE over three contiguous folds, several at a time.
    Returns the best settings and the model refitted with them on all rows."""
    folded = with_folds(train, series=series, ts=ts).persist()
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=[_param_map(estimator, p) for p in candidates],
        evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"), numFolds=3, foldCol="_fold",
        parallelism=parallelism,
    )
    try:
        fitted = cv.fit(folded)
    finally:
        folded.unpersist()
    return candidates[int(np.argmin(fitted.avgMetrics))], fitted.bestModel


def fit_forest(
    train: DataFrame, features: Sequence[str], *, target: str = "y", series: str = "series_id", ts: str = "ts",
    params: dict | None = None, tune: bool = True, draws: int = 10, grid: dict | None = None, seed: int = 42,
    parallelism: int = 4,
) -> TreeModel:
    """Random forest; by default after a random search over the grid."""
    chosen = {**FOREST_DEFAULTS, **(params or {})}
    train = _assembler(features).transform(train)
    if tune:
        candidates = draw(grid or FOREST_GRID, draws, seed)
        _, best = _search(train, _forest(chosen, target, seed), candidates, target=target, series=series, ts=ts, parallelism=parallelism)
        return TreeModel("RandomForest", PipelineModel([_assembler(features), best]), list(features))
    return _fitted("RandomForest", _forest(chosen, target, seed), train, features)


def _fitted(name: str, estimator, assembled: DataFrame, features: Sequence[str]) -> TreeModel:
    model = estimator.fit(assembled)
    return TreeModel(name, PipelineModel([_assembler(features), model]), list(features))


def fit_boosted_a(
    train: DataFrame, features: Sequence[str], *, target: str = "y", series: str = "series_id", ts: str = "ts",
    params: dict | None = None, tune: bool = True, draws: int = 10, grid: dict | None = None, seed: int = 42,
    parallelism: int = 4,
) -> TreeModel:
    """Boosted trees, level-wise, row and column sampling, early stopping on the newest rows."""
    chosen = {**BOOSTED_A_DEFAULTS, **(params or {})}
    train = _assembler(features).transform(train)
    if tune:
        candidates = draw(grid or BOOSTED_A_GRID, draws, seed)
        chosen, _ = _search(
            train, _boosted(chosen, target, seed, None), candidates, target=target, series=series, ts=ts, parallelism=parallelism)
    return _boost("BoostedA", chosen, train, features, target, series, ts, seed)


def _boost(name, params, assembled, features, target, series, ts, seed) -> TreeModel:
    held = with_holdout(assembled, series=series, ts=ts)
    marked = held.agg(F.max(F.col("_holdout").cast("int"))).first()[0]
    return _fitted(name, _boosted(params, target, seed, "_holdout" if marked else None), held, features)


def boosted_b_candidates(n: int, seed: int) -> list[dict]:
    """Random draws from the sequential search's ranges."""
    rng = random.Random(seed)
    return [
        {
            "trees": rng.randrange(100, 501, 100), "rate": 10 ** rng.uniform(-2, -1), "depth": rng.randint(4, 10),
            "min_leaf": rng.randint(10, 50), "rows": rng.uniform(0.6, 1.0), "columns": round(rng.uniform(0.6, 1.0), 3),
        }
        for _ in range(n)
    ]


def fit_boosted_b(
    train: DataFrame, features: Sequence[str], *, target: str = "y", series: str = "series_id", ts: str = "ts",
    params: dict | None = None, tune: bool = True, trials: int = BOOSTED_B_TRIALS, candidates: list[dict] | None = None,
    seed: int = 42, parallelism: int = 4,
) -> TreeModel:
    """Second boosted configuration; trials are compared on the newest rows of each series."""
    chosen = {**BOOSTED_B_DEFAULTS, **(params or {})}
    assembled = _assembler(features).transform(train)
    if tune:
        held = with_holdout(assembled, series=series, ts=ts).persist()
        evaluator = RegressionEvaluator(labelCol=target, metricName="rmse")
        newest = held.filter("_holdout")
        try:
            def score(i: int) -> tuple[float, int]:
                return evaluator.evaluate(_boosted(settings[i], target, seed, "_holdout").fit(held).transform(newest)), i

            settings = candidates or boosted_b_candidates(trials, seed)
            with ThreadPool(parallelism) as pool:
                scored = pool.map(inheritable_thread_target(train.sparkSession)(score), range(len(settings)))
        finally:
            held.unpersist()
        chosen = settings[min(scored)[1]]
    return _boost("BoostedB", chosen, assembled, features, target, series, ts, seed)
