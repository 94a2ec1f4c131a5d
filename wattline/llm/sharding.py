"""Contiguous shards of nearly equal byte size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, prefix_sums, reliable, table

SHARDS = 16


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text plus 1 for the record's end; a null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS, order: Sequence[str] = ("doc_id",), size: str = "size") -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (place in the shard, from 0).

    Rows follow ``order`` (nulls last; ties follow the input) and are cut where the global prefix sum of
    ``size`` passes equal targets: a row goes to the shard that holds its middle byte, so a shard is
    at most one row larger or smaller than its target. Sizes are positive; a table with fewer rows than
    shards leaves shards empty, an empty one gives no rows. Existing ``shard`` and ``slot`` columns are
    replaced. Everything is built-in functions."""
    docs = docs.drop("shard", "slot")
    inner = {c: fresh(docs, f"own_{k}") for k, c in enumerate(docs.columns)}  # names that the sums cannot clash with
    sums = prefix_sums(docs.select([F.col(c).alias(n) for c, n in inner.items()]), [inner[c] for c in order], inner[size])
    middle = f"({shards} * (2 * before + `{inner[size]}`)) div (2 * total)"
    cut = sums.withColumn("shard", F.least(F.lit(shards - 1), F.expr(middle)).cast("int"))
    # one row per shard, so the broadcast is bounded by the number of shards
    starts = cut.groupBy("shard").agg(F.min("index").alias("start"))
    placed = cut.join(F.broadcast(starts), "shard")
    return placed.select(*[F.col(n).alias(c) for c, n in inner.items()], "shard", (F.col("index") - F.col("start")).alias("slot"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = reliable(docs.select(
        "doc_id", text_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),  # a null has the checksum of no bytes
    ))
    return shards_by_bytes(slim).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = f"""
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
crc_table as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as t),
sized as (
  select doc_id, (len(h) // 2 + 1)::bigint as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32
  from bytes, crc_table),
sums as (
  select *, coalesce(sum(size) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from sized),
cut as (select *, least({SHARDS - 1}, ({SHARDS} * (2 * before + size)) // (2 * total))::int as shard from sums)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard
from cut
"""
