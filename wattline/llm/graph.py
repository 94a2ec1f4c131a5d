"""Connected components of distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, reliable


def _starred(links: DataFrame, larger: bool) -> DataFrame:
    """One star step. Every node hooks its larger (or its smaller) neighbours to the smallest of its neighbours and itself."""
    if larger:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        hooked = down.join(least, "a")
        out = hooked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) links of longs to (node, root): root is the smallest node of its component; a node without links is absent.

    Large and small stars in turn until nothing changes, at most log squared rounds; each round is written to
    the shared folder. A hub's links are split by the join, its smallest neighbour by the partial aggregate.
    ``rows``: how many links there are at most, if that is known; a star step adds none, so later tables are packed by the count before."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = reliable(links) if rows is None else packed(links, rows)
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b")).distinct()
        seen = state
        links = packed(_starred(_starred(links, True), False), state[0])
