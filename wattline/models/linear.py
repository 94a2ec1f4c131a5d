"""Least squares per series from summed cross products.

Cross products are summed per task with BLAS, then by Spark over (series, i, j), so a
hot series arrives as at most one small partial per task and pair. Only the finished
matrix, whose size depends on the number of features alone, is solved in a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RCOND = 1e-10


def cross_products(df: DataFrame, cols: Sequence[str], *, series: str = "series_id") -> DataFrame:
    """``(series, i, j, v)`` with ``v`` the sum of ``z_i z_j`` over the rows, ``j >= i``,
    where ``z`` is a constant 1 followed by ``cols``."""
    cols = list(cols)
    size = len(cols) + 1
    upper = [np.arange(i, size) for i in range(size)]
    schema = T.StructType([
        df.schema[series], T.StructField("i", T.IntegerType()), T.StructField("vs", T.ArrayType(T.DoubleType()))
    ])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, np.zeros((size, size))

        def emit() -> pd.DataFrame:
            return pd.DataFrame([(held, i, own[i, upper[i]]) for i in range(size)], columns=[series, "i", "vs"])

        for batch in batches:
            values = batch[cols].to_numpy(dtype=float)
            z = np.hstack([np.ones((len(values), 1)), values])
            for sid, rows in batch.groupby(series, sort=False).indices.items():
                if held is not None and sid != held:
                    yield emit()
                    own = np.zeros((size, size))
                held, part = sid, z[rows]
                own = own + part.T @ part
        if held is not None:
            yield emit()

    numeric = [F.col(c).cast("double").alias(c) for c in cols]
    # sorted, so a task holds one series at a time and gives one partial matrix for each
    parts = df.select(series, *numeric).filter(F.col(series).isNotNull()).sortWithinPartitions(series).mapInPandas(partial, schema)
    flat = parts.select(series, "i", F.posexplode("vs").alias("k", "v"))
    return flat.groupBy(series, "i", (F.col("i") + F.col("k")).alias("j")).agg(F.sum("v").alias("v"))


def _matrix(pdf: pd.DataFrame, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    g[i, j] = pdf["v"].to_numpy()
    g[j, i] = pdf["v"].to_numpy()
    return g


COEF_FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("scaled_coef", T.ArrayType(T.DoubleType())),
    T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("sd", T.ArrayType(T.DoubleType())),
]


def solve(products: DataFrame, n_features: int, *, series: str = "series_id", intercept: bool = True) -> DataFrame:
    """Coefficients per series. With an intercept the features are z-scored first and
    ``scaled_coef`` is in those units; collinear features get the minimum-norm solution."""
    schema = T.StructType([products.schema[series], *COEF_FIELDS])
    p = n_features

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _matrix(pdf, p + 2)
        n = g[0, 0]
        if intercept:
            mean = g[0, 1:] / n
            cov = g[1:, 1:] / n - np.outer(mean, mean)
            var = np.clip(np.diag(cov), 0.0, None)
            # a variance lost in rounding means a constant column
            sd = np.where(var > 1e-12 * (np.abs(mean) ** 2 + 1e-12), np.sqrt(var), 1.0)
            usable = sd[:p] != 1.0
            corr = np.where(np.outer(usable, usable), cov[:p, :p] / np.outer(sd[:p], sd[:p]), 0.0)
            beta = np.linalg.pinv(corr, rcond=RCOND, hermitian=True) @ np.where(usable, cov[:p, p] / sd[:p], 0.0)
            coef = beta / sd[:p]
            b0 = float(mean[p] - coef @ mean[:p])
            mean, sd = mean[:p], sd[:p]
        else:
            coef = np.linalg.pinv(g[1:p + 1, 1:p + 1], rcond=RCOND, hermitian=True) @ g[1:p + 1, p + 1]
            beta, b0, mean, sd = coef, 0.0, np.zeros(p), np.ones(p)
        return pd.DataFrame({
            series: [pdf[series].iloc[0]], "n": [int(n)], "intercept": [b0], "coef": [coef.tolist()],
            "scaled_coef": [np.asarray(beta).tolist()], "mean": [mean.tolist()], "sd": [sd.tolist()],
        })

    return products.groupBy(series).applyInPandas(one, schema)


def dot(cols: Sequence[str], coef: Column) -> Column:
    """Sum of columns times the entries of an array column, as one flat expression."""
    total = F.lit(0.0)
    for i, c in enumerate(cols):
        total = total + F.col(c) * coef[i]
    return total


class LinearModel:
    """Fitted per-series linear regression; ``table`` has one row per series."""

    name = "LinearRegression"
    statistical = False

    def __init__(self, table: DataFrame, features: Sequence[str], series: str = "series_id") -> None:
        self.table, self.features, self.series = table, list(features), series

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        weights = self.table.select(self.series, F.col("intercept").alias("_b0"), F.col("coef").alias("_b"))
        return df.join(weights, self.series).withColumn(out, F.col("_b0") + dot(self.features, F.col("_b"))).drop("_b0", "_b")

    def parameters(self) -> DataFrame:
        return self.table.select(self.series, F.col("intercept").alias("_b0"), F.col("coef").alias("_b"))

    def panel_scorer(self):
        def prepare(rows: pd.DataFrame):
            first, weights = rows["_b0"].to_numpy(dtype=float), np.stack(rows["_b"].to_numpy())
            return lambda x: first + (weights * x).sum(axis=1)

        return prepare

    def matrix_scorer(self):
        return lambda x, own: own["_b0"] + x @ np.asarray(own["_b"])

    def importances(self) -> DataFrame:
        """Absolute z-score coefficients, long form."""
        names = F.array(*[F.lit(f) for f in self.features])
        pair = F.explode(F.arrays_zip(names.alias("feature"), F.col("scaled_coef").alias("c")))
        return self.table.select(self.series, pair.alias("e")).select(
            self.series, F.col("e.feature").alias("feature"), F.abs("e.c").alias("importance")
        )

    def save(self, path: str) -> None:
        self.table.withColumn("features", F.lit(self.features).cast("array<string>")).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, series: str = "series_id") -> LinearModel:
        table = spark.read.parquet(path)
        return cls(table.drop("features"), table.select("features").first()[0], series)


def fit_linear(df: DataFrame, features: Sequence[str], *, series: str = "series_id", target: str = "y") -> LinearModel:
    """Z-scored ordinary least squares, one model per series."""
    products = cross_products(df, [*features, target], series=series)
    return LinearModel(solve(products, len(features), series=series), features, series)
