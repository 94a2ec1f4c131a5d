"""Save, load and look for named models, one folder per name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wattline.models.arima import ArimaModel
from wattline.models.linear import LinearModel
from wattline.models.series_trees import SeriesTreeModel
from wattline.models.trees import TreeModel

KINDS = {"linear": LinearModel, "trees": TreeModel, "series_trees": SeriesTreeModel, "arima": ArimaModel}


def _kind(model) -> str:
    return next(k for k, cls in KINDS.items() if isinstance(model, cls))


def save_model(model, folder: str, name: str) -> None:
    spark = SparkSession.getActiveSession()
    model.save(f"{folder}/{name}/model")
    spark.createDataFrame([(_kind(model),)], "kind string").write.mode("overwrite").json(f"{folder}/{name}/kind")


def load_model(spark: SparkSession, folder: str, name: str):
    if not model_exists(spark, folder, name):
        raise ValueError(f"no trained model {name!r}; train one first")
    kind = spark.read.schema("kind string").json(f"{folder}/{name}/kind").first()["kind"]
    return KINDS[kind].load(spark, f"{folder}/{name}/model")


def model_exists(spark: SparkSession, folder: str, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{name}/kind/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
