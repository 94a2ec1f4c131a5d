"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, numbered, reliable, table

# Runs that meet in a node of the tree.
FAN_IN = 16
_RUN = "node long, digest binary, bytes long, keep_id long, keep_row long, group_size long"


def normalised(text: str = "text") -> Column:
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _words(column: pa.Array, width: int = 32) -> np.ndarray:
    """Digests of one width as rows of unsigned numbers."""
    start = column.offset * width + np.frombuffer(column.buffers()[1], np.int32, 1)[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[start:start + len(column) * width].view(np.uint64).reshape(-1, width // 8)


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a node, which arrive in the order of digest, size and identifier, to one run.

    Rows of equal digest and byte size become one with the smallest identifier and the sum of their
    sizes. It streams: only the last entry waits for the next batch. That no later identifier is smaller than
    the one retained is verified."""
    open_entry = None
    for batch in batches:
        rows = pa.Table.from_arrays(batch.columns, batch.schema.names)  # batches differ in what may be null
        if open_entry is not None:
            rows = pa.concat_tables([open_entry, rows])
        rows = rows.combine_chunks()
        if not rows.num_rows:
            continue
        digest = _words(rows["digest"].chunk(0))
        node, size = rows["node"].to_numpy(), rows["bytes"].to_numpy()
        first = np.ones(rows.num_rows, bool)
        first[1:] = (digest[1:] != digest[:-1]).any(1) | (node[1:] != node[:-1]) | (size[1:] != size[:-1])
        starts = np.flatnonzero(first)
        ids = pc.fill_null(rows["keep_id"], np.iinfo(np.int64).max).to_numpy()
        if (np.minimum.reduceat(ids, starts) < ids[starts]).any():
            raise AssertionError("a run is out of order: its entry is not the smallest identifier")
        merged = rows.take(starts)
        merged = merged.set_column(5, "group_size", pa.array(np.add.reduceat(rows["group_size"].to_numpy(), starts)))
        open_entry = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if open_entry is not None:
        yield from open_entry.combine_chunks().to_batches()



def _in_order(runs: DataFrame, *first: str) -> DataFrame:
    return runs.sortWithinPartitions(*first, "node", "digest", "bytes", F.asc_nulls_last("keep_id"), "keep_row")


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(leaf runs, groups) of ``numbered`` rows with id, digest (32 bytes) and bytes.

    Each task sorts its rows to a run with one entry per digest. Then runs are exchanged in rounds: ``fan_in``
    runs meet in the node node / fan_in of the next level, where they are merged. A node is cut by the first
    two bytes of the digest, so the last level is as wide as the cluster and a task holds no run.
    A digest of a third of all rows is one entry per run from the start. The external sort of the shuffle
    does the merging order, ``collapse`` the retaining; the rounds are log(tasks), 4 for 50,000 tasks."""
    entries = rows.select("node", "digest", "bytes", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    leaves = reliable(_in_order(entries).mapInArrow(collapse, _RUN))
    runs = leaves
    nodes = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        prefix = F.substring("digest", 1, 2)
        runs = runs.withColumn("node", F.expr(f"node div {fan_in}")).withColumn("cut", prefix).repartition("cut", "node")
        runs = _in_order(runs, "cut").drop("cut").mapInArrow(collapse, _RUN)
        nodes = -(-nodes // fan_in)
        if nodes == 1:
            return leaves, runs.drop("node")


def duplicates(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Adds keep_id, group_size and kept to ``numbered`` rows with id, digest and bytes.

    In a group the smallest id stays (null ids last); of rows that share it, the first in the input."""
    leaves, groups = tree_merge(rows, fan_in)
    copied = groups.filter("group_size > 1")
    local = leaves.select("node", "digest", "bytes").join(copied, ["digest", "bytes"])
    joined = rows.join(local.distinct(), ["node", "digest", "bytes"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        *[c for c in rows.columns], F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))


def digested(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``numbered`` rows with id, digest (SHA-256 of the normalised text) and bytes, its size."""
    return numbered(docs.select(F.col(doc_id).cast("long").alias("id"), normalised(text).alias("t"))
                    .select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("bytes")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Null and empty texts are one group; an empty table gives none."""
    row, node = fresh(docs, "row"), fresh(docs, "node")
    digest, size = fresh(docs, "digest"), fresh(docs, "bytes")
    held = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(digest, normalised(text))
    held = held.withColumn(size, F.octet_length(digest).cast("long")).withColumn(digest, F.unhex(F.sha2(digest, 256)))
    held = reliable(held.withColumn(node, F.shiftright(row, 33)))
    slim = held.select(F.col(doc_id).cast("long").alias("id"), F.col(row).alias("row"), F.col(node).alias("node"), F.col(digest).alias("digest"), F.col(size).alias("bytes"))
    gone = duplicates(slim).filter("not kept").select(F.col("row").alias(row))
    return held.join(gone, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    found = duplicates(digested(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
