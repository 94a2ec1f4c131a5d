"""Helpers shared by the operators: row numbers, hot-key joins, distributed prefix sums and files."""

from __future__ import annotations

import ctypes
import gc
import posixpath
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.session import checkpoint_folder, ship_package

__all__ = ["WORD", "SPACES", "attach", "create", "delete", "file_system", "fresh", "new_folder", "numbered", "packed",
           "prefix_sums", "release", "reliable", "scratch", "ship_package", "table"]

# Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
# monotonically_increasing_id puts the partition number above this many bits.
_NODE_BITS = 33
# Rows of a file of ``packed``, where there are that many.
FILE_ROWS = 1 << 17
_scopes = threading.local()


def reliable(df: DataFrame) -> DataFrame:
    """The rows, written once to the session's shared folder and read from there: row numbers and sampled bounds are fixed, and a lost
    executor costs no recomputation. Texts are the bulk of such tables, so they are packed harder than by default."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (scope := getattr(_scopes, "tables", None)) is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``reliable`` for slim tables of about ``rows`` rows: their number decides how many tasks write, one a core at least. Small tables
    would have a file per shuffle partition else, and an executor that writes to a local file system starts processes for each file."""
    return reliable(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``reliable`` writes within the block (and on its thread) are deleted at its end; write first what reads them. Gives a
    ``reliable`` whose tables stay for what is around the block."""
    outer, _scopes.tables = getattr(_scopes, "tables", None), []

    def keep(df: DataFrame) -> DataFrame:
        inner, _scopes.tables = _scopes.tables, outer
        try:
            return reliable(df)
        finally:
            _scopes.tables = inner

    try:
        yield keep
    finally:
        for path in _scopes.tables:
            delete(spark, path)
        _scopes.tables = outer


def release() -> None:
    """Gives free memory of a Python worker back to the system. Workers wait for later tasks beside the executor's own memory, and keep
    what the largest one took otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder through Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with a number after it if the table has such a column (case ignored)."""
    taken, out, k = {c.lower() for c in df.columns}, name, 1
    while out.lower() in taken:
        k, out = k + 1, f"{name}_{k}"
    return out


def numbered(df: DataFrame) -> DataFrame:
    """Written table with ``row``, a number of the row, and ``node``, the task that wrote it.

    The numbers are fixed by writing them: they hold when an executor is lost later on."""
    return reliable(df.withColumn("row", F.monotonically_increasing_id())
                    .withColumn("node", F.shiftright("row", _NODE_BITS)))


def attach(rows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` (of ``numbered``) with one row of ``values`` per key.

    ``values`` first meets the distinct pairs of node and key, so that a key of a third of all
    rows counts one row per node there; the second join is on node and key and spreads the
    hot key over all nodes. Keys are not null."""
    local = rows.select("node", *keys).distinct().join(values, list(keys))
    return rows.join(local, ["node", *keys], "left")


def prefix_sums(df: DataFrame, order: Sequence[str], value: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds to each row ``before`` (sum of ``value`` over earlier rows of its group), ``index`` (number of
    earlier rows), ``total`` and ``count`` (of the group). Rows that tie follow their number in the input.

    The rows are range-partitioned by group and order and written, so that their places are
    fixed; totals per partition are summed over the partitions, of which there are few, and
    added to sums within each partition. No task holds a group."""
    first = [F.asc_nulls_last(c) for c in [*within, *order, "row"]]
    if "row" not in df.columns:
        df = df.withColumn("row", F.monotonically_increasing_id())
    placed = reliable(df.repartitionByRange(*first).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part", *within).agg(F.sum(value).alias("part_sum"), F.count(F.lit(1)).alias("part_rows"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = parts.select(
        "part", *within,
        F.coalesce(F.sum("part_sum").over(earlier), zero).alias("sum_offset"),
        F.coalesce(F.sum("part_rows").over(earlier), zero).alias("row_offset"),
        F.sum("part_sum").over(group).alias("total"), F.sum("part_rows").over(group).alias("count"),
    )
    inside = Window.partitionBy("part", *within).orderBy(*[F.asc_nulls_last(c) for c in [*order, "row"]])
    sums = placed.select(
        "*", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero).alias("sum_inside"),
        (F.row_number().over(inside) - 1).alias("rows_inside"),
    )
    joined = sums.alias("s").join(
        parts.alias("p"), [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ["part", *within]])
    return joined.select(
        "s.*", (F.col("s.sum_inside") + F.col("p.sum_offset")).alias("before"),
        (F.col("s.rows_inside") + F.col("p.row_offset")).alias("index"), "p.total", "p.count",
    ).drop("sum_inside", "rows_inside", "part", "row")



def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for files in the shared folder of the session."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(file system, path) of a URI or an absolute path: local, HDFS or an object store."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def create(uri: str):
    """Output stream of a new file, its folder made first."""
    store, path = file_system(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path)
