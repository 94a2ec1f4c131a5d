"""Session settings and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Run-time settings every operator relies on. Shuffle partitions are left to the
# cluster: AQE coalesces small ones and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Windows and grouped functions cost far more per byte than a scan: let AQE keep small
    # shuffles spread over the cores. Without effect once shuffles are large.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Inferred constraints grow exponentially over a wide projection of one column, which
    # is what calendar features are: planning a join on such a frame would not end.
    "spark.sql.constraintPropagation.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "wattline", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a configured session; ``master`` is for tests and benches."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own, or a temporary one in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="wattline-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared checkpoint folder, so that values fixed at
    this point (row ids, sampled range bounds) survive a lost executor.

    A written table computes its input once (an RDD checkpoint runs the last stage
    twice) and later reads prune its columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, old: DataFrame) -> DataFrame:
    """``reliable``, after which ``old``, a table that ``reliable`` gave and nothing else reads any more, goes."""
    new, spark = reliable(df), df.sparkSession
    if files := old.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return new


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application. A session may have been
    started without the package on its path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wattline-code-")) / "wattline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
