"""Exact k nearest neighbours per series without comparing all pairs.

Rows are sorted along a Z-order curve and cut into leaves of a fixed row count. Each
leaf first finds neighbours inside itself, which bounds how far any better neighbour can
be. A packed R-tree over the leaf boxes (fan-out ``FANOUT``, joined level by level) then
lists the leaves that bound still reaches, and only the rows whose own bound reaches
a leaf are compared with it. Every group a task sees is bounded by the leaf size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.ordering import choose_plan, largest_group, positions
from wattline.session import reliable

LEAF_ROWS = 2048
FANOUT = 64
SLICE_LEAVES = 16  # probing leaves handled together
BLOCK_ROWS = 1024  # rows of a distance block held in memory
REACH = 4.0        # standardised values are quantised over [-REACH, REACH]


def z_order(x: Column, dims: int) -> Column:
    """Interleaved bits of the quantised coordinates."""
    bits = min(12, 60 // dims)
    top = (1 << bits) - 1
    cells = [
        F.greatest(F.lit(0), F.least(F.lit(top), F.floor((x[i] + REACH) / (2 * REACH) * (top + 1)))).cast("long")
        for i in range(dims)
    ]
    code = F.lit(0).cast("long")
    for b in range(bits):
        for i, cell in enumerate(cells):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, b * dims + i))
    return code


def nearest(x: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, k: int):
    """Per row of ``x`` the ``k`` nearest rows of ``other`` by (distance, id), itself excluded."""
    for start in range(0, len(x), BLOCK_ROWS):
        part, part_ids = x[start:start + BLOCK_ROWS], ids[start:start + BLOCK_ROWS]
        d2 = np.zeros((len(part), len(other)))
        for j in range(x.shape[1]):
            d2 += (part[:, j][:, None] - other[:, j][None, :]) ** 2
        dist = np.sqrt(d2)
        dist[part_ids[:, None] == other_ids[None, :]] = np.inf
        keep = min(k, dist.shape[1])
        edge = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
        for r in range(len(part)):
            near = np.flatnonzero(dist[r] <= edge[r])
            near = near[np.isfinite(dist[r][near])]
            near = near[np.lexsort((other_ids[near], dist[r][near]))][:k]
            yield start + r, other_ids[near], dist[r][near]


CANDIDATE = T.ArrayType(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("nbr", T.LongType())]))


def _pairs(ids, dists) -> list[dict]:
    return [{"dist": float(d), "nbr": int(i)} for i, d in zip(ids, dists)]


def knn(
    points: DataFrame, k: int, dims: int, *, series: str = "series_id", leaf_rows: int = LEAF_ROWS, plan: str = "auto"
) -> DataFrame:
    """``points(series, id long, x array<double>)`` to ``(series, id, near)`` with ``near`` the
    ``k`` nearest ``struct(dist, nbr)`` in order. Ids must be unique per series."""
    points = points.select(series, "id", "x")
    size = largest_group(points, [series])
    if plan == "auto":
        plan = choose_plan(points, [series], plan) if size > leaf_rows else "plain"
    placed = positions(points.withColumn("_z", z_order(F.col("x"), dims)), [series], ["_z", "id"], pos="_pos", plan=plan)
    placed = placed.withColumn("leaf", F.floor(F.col("_pos") / leaf_rows)).drop("_pos", "_z")
    local_schema = T.StructType([
        points.schema[series], T.StructField("leaf", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("bound", T.DoubleType()),
        T.StructField("near", CANDIDATE),
    ])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy()
        near, bound = [None] * len(ids), np.full(len(ids), np.inf)
        for r, nbr, dist in nearest(x, ids, x, ids, k):
            near[r] = _pairs(nbr, dist)
            if len(nbr) == k:
                bound[r] = dist[-1]
        return pdf.assign(bound=bound, near=near)[[series, "leaf", "id", "x", "bound", "near"]]

    local = placed.groupBy(series, "leaf").applyInPandas(inside, local_schema)
    if size <= leaf_rows:
        return local.select(series, "id", "near")

    local = reliable(local)  # read by the boxes, the probes and the merge
    far = _reachable_leaves(local, dims, series, -(-size // leaf_rows))
    gap = _gap([(F.col("x")[i], F.col("x")[i], F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(dims)])
    probes = (
        local.join(far.withColumnRenamed("_a", "leaf"), [series, "leaf"])
        .filter(gap < F.col("bound"))
        .select(series, F.col("_b").alias("leaf"), F.floor(F.col("leaf") / SLICE_LEAVES).alias("slice"), "id", "x", "bound")
    )
    wanted = probes.select(series, "leaf", "slice").distinct()
    targets = local.select(series, "leaf", "id", "x").join(wanted, [series, "leaf"])
    targets = targets.withColumnsRenamed({series: "_series", "leaf": "_leaf", "slice": "_slice", "id": "other_id", "x": "other_x"})
    found_schema = T.StructType([points.schema[series], T.StructField("id", T.LongType()), T.StructField("near", CANDIDATE)])

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids, bound = np.stack(left["x"].to_numpy()), left["id"].to_numpy(), left["bound"].to_numpy()
            other, other_ids = np.stack(right["other_x"].to_numpy()), right["other_id"].to_numpy()
            for r, nbr, dist in nearest(x, ids, other, other_ids, k):
                # ties at the bound can still win on the id
                ok = dist <= bound[r]
                if ok.any():
                    out.append((left[series].iloc[0], ids[r], _pairs(nbr[ok], dist[ok])))
        return pd.DataFrame(out, columns=[series, "id", "near"])

    found = probes.groupBy(series, "leaf", "slice").cogroup(targets.groupBy("_series", "_leaf", "_slice")).applyInPandas(across, found_schema)
    merged = local.select(series, "id", "near").unionByName(found).groupBy(series, "id").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    )
    return merged


def _gap(sides: list[tuple]) -> Column:
    """Distance between two boxes given per axis as (lo_a, hi_a, lo_b, hi_b)."""
    total = F.lit(0.0)
    for lo_a, hi_a, lo_b, hi_b in sides:
        apart = F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))
        total = total + apart * apart
    return F.sqrt(total)


def _reachable_leaves(local: DataFrame, dims: int, series: str, leaves: int) -> DataFrame:
    """Pairs (leaf a, other leaf b) whose boxes are nearer than the loosest bound in a."""
    box = [f(F.col(f"{n}{i}")).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = local.select(
        series, "leaf", "bound", *[F.col("x")[i].alias(f"{n}{i}") for i in range(dims) for n in ("lo", "hi")]
    ).groupBy(series, "leaf").agg(F.max("bound").alias("bound"), *box)
    boxes = reliable(boxes)  # one row per leaf, read once per level
    levels = 0
    while FANOUT ** levels < leaves:
        levels += 1
    front = boxes.select(
        series, F.col("leaf").alias("_a"), F.col("bound").alias("_r"), F.lit(0).cast("long").alias("_node"),
        *[F.col(f"{n}{i}").alias(f"a{n}{i}") for i in range(dims) for n in ("lo", "hi")],
    )
    for level in range(levels - 1, -1, -1):
        node = F.floor(F.col("leaf") / FANOUT ** level)
        nodes = boxes.groupBy(series, node.alias("_child")).agg(*box).withColumn("_node", F.floor(F.col("_child") / FANOUT))
        sides = [(F.col(f"alo{i}"), F.col(f"ahi{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(dims)]
        front = front.join(nodes, [series, "_node"]).filter(_gap(sides) < F.col("_r"))
        kept = [series, "_a", "_r", *[f"a{n}{i}" for i in range(dims) for n in ("lo", "hi")]]
        own = [f"{n}{i}" for i in range(dims) for n in ("lo", "hi")] if level == 0 else []
        front = front.select(*kept, F.col("_child").alias("_node"), *own)
    return front.filter(F.col("_a") != F.col("_node")).select(
        series, "_a", F.col("_node").alias("_b"), *[f"{n}{i}" for i in range(dims) for n in ("lo", "hi")]
    )
