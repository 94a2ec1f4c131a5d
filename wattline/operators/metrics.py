"""Chronological splits and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.scalar import mae, mape, rmse
from wattline.operators.ordering import positions


def time_split(
    df: DataFrame, *, series: str = "series_id", ts: str = "ts", test_size: float = 0.2,
    val_size: float = 0.0, out: str = "split", plan: str = "auto",
) -> DataFrame:
    """Label rows ``train`` / ``val`` / ``test`` in time order, never shuffled.

    The test and validation parts hold ``int(n * share)`` rows each."""
    ranked = positions(df, [series], [ts], pos="_i", total="_n", plan=plan)
    n = F.col("_n")
    test_n, val_n = F.floor(n * F.lit(test_size)), F.floor(n * F.lit(val_size))
    label = (
        F.when(F.col("_i") < n - test_n - val_n, "train").when(F.col("_i") < n - test_n, "val").otherwise("test")
    )
    return ranked.withColumn(out, label).drop("_i", "_n")


def metrics_table(
    df: DataFrame, *, actual: str = "y", predicted: str = "prediction",
    keys: Sequence[str] = ("series_id", "model"), digits: int | None = None,
) -> DataFrame:
    """RMSE, MAE and MAPE (percent) per key, optionally rounded."""
    cols = {"rmse": rmse(actual, predicted), "mae": mae(actual, predicted), "mape": mape(actual, predicted)}
    aggs = [(F.round(c, digits) if digits is not None else c).alias(n) for n, c in cols.items()]
    return df.groupBy(*keys).agg(*aggs)


def naive_baseline(
    split: DataFrame, *, series: str = "series_id", target: str = "y", label: str = "split"
) -> DataFrame:
    """RMSE of predicting every test row by the train mean.

    Needs no join back: sum((y - m)^2) over the test rows is kept as count, mean and
    variance, each of which combines on the map side."""
    test = F.col(label) == "test"
    y = F.col(target)
    agg = split.groupBy(series).agg(
        F.avg(F.when(F.col(label) == "train", y)).alias("_m"),
        F.avg(F.when(test, y)).alias("_tm"),
        F.var_pop(F.when(test, y)).alias("_tv"),
    )
    bias = F.col("_tm") - F.col("_m")
    return agg.select(series, F.sqrt(F.col("_tv") + bias * bias).alias("baseline_rmse"))
