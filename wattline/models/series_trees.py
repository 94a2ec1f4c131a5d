"""Tree ensembles of single series: forests, second-order boosting level by level and boosting by the best leaf.

Every series has models of its own, so no other owner's rows shape its predictions. A series that a task can hold is trained in one task,
or in one per candidate of a search. A longer one is binned and written, and each level of its trees is one job over all its
rows: tasks sum histograms, the sums meet by (tree, node, feature, bin), and windows over bins give the best splits. Its searches
try the same settings on the same rows; boosted trials that do not depend on each other share jobs. Both ways give the same trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.models.histograms import LocalRows, Rule, Split, Tree, bin_codes, bin_edges, growing, histograms, poisson, target_scale, uniform
from wattline.models.proposals import RANDOM_TRIALS, Range, propose
from wattline.models.trees import BOOSTED_A_DEFAULTS, BOOSTED_A_GRID, FOREST_DEFAULTS, FOREST_GRID, TreeNodes, draw
from wattline.operators.ordering import MAX_GROUP_ROWS, positions
from wattline.session import reliable, replaced

# Bins per feature; their edges come from all rows that trees are grown from.
FOREST_BINS, BOOSTED_BINS = 64, 256
# Settings of leaf-wise boosting, its search ranges and trials, and rounds without progress that end boosting and a trial.
BOOSTED_B_DEFAULTS = {"trees": 200, "rate": 0.05, "depth": 6, "leaves": 31, "min_leaf": 20, "rows": 1.0, "columns": 1.0}
BOOSTED_B_RANGES = {
    "trees": Range(100, 500, whole=True, step=100), "rate": Range(0.01, 0.1, log=True), "leaves": Range(20, 100, whole=True),
    "depth": Range(4, 10, whole=True), "min_leaf": Range(10, 50, whole=True), "rows": Range(0.6, 1.0), "columns": Range(0.6, 1.0),
}
TRIALS = 15
PATIENCE, TRIAL_PATIENCE = 15, 10
L2 = 1.0
# Rows that one task predicts for, histogram cells that a job's tasks hold, and rounds between two writings of a long series' predictions.
PREDICT_ROWS = 100_000
CELLS = 1 << 23
WRITE_ROUNDS = 10

_PARTS = {"root": np.int64, "weight": float, "feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float, "count": float}
MODEL_SCHEMA = "params string, n_trees int, base double, gains array<double>, " + ", ".join(f"_{p} binary" for p in _PARTS)


def rule_of(kind: str, p: dict) -> Rule:
    """How trees of a kind of ensemble grow. All take the mean target, or gradient, of a leaf; boosting A adds L2 to its weight."""
    if kind == "RandomForest":
        return Rule(depth=p["depth"], least_rows=p["min_leaf"], split_rows=p["min_split"])
    if kind == "BoostedA":
        return Rule(depth=p["depth"], l2=p.get("l2", L2), least_gain=p.get("least_gain", 0.0))
    return Rule(depth=p["depth"], leaves=p["leaves"], least_rows=p["min_leaf"])


def weights_of(kind: str, p: dict, rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Weight of every row in a tree: a sample with replacement for forests (each row a Poisson number of times), without for boosting."""
    if kind == "RandomForest":
        return poisson(uniform(rows, seed, tree)) if p.get("bootstrap", True) else np.ones(len(rows))
    return (uniform(rows, seed, tree) < p["rows"]).astype(float) if p["rows"] < 1 else np.ones(len(rows))


def columns_of(kind: str, p: dict, n: int, tree: int, seed: int) -> np.ndarray | None:
    """Columns that a tree may use; None for all."""
    if kind == "RandomForest" or p["columns"] >= 1:
        return None
    out = np.zeros(n, bool)
    out[np.random.default_rng([seed, tree]).permutation(n)[:max(1, int(p["columns"] * n))]] = True
    return out


@dataclass
class Ensemble:
    """Trees with their bin edges: the sum of ``factor`` times the leaves, added to ``base``."""

    base: float
    factor: float
    trees: list[Tree]
    edges: list[np.ndarray]
    rule: Rule
    sign: float

    def leaves(self, tree: Tree) -> np.ndarray:
        h = np.array(tree.h)
        return self.sign * np.array(tree.g) / np.maximum(h + self.rule.l2, 1e-300)

    def of_codes(self, codes: np.ndarray, trees: Sequence[Tree] | None = None, start: np.ndarray | float | None = None) -> np.ndarray:
        out = np.full(len(codes), self.base if start is None else start, float)
        for t in self.trees if trees is None else trees:
            out += self.factor * self.leaves(t)[t.walk(codes)]
        return out

    def row(self, params: dict) -> dict:
        """As a row of the model table; node numbers count over all trees."""
        gains = np.zeros(len(self.edges))
        starts = np.cumsum([0, *(len(t.g) for t in self.trees)])
        parts: dict[str, list] = {p: [] for p in _PARTS}
        for start, t in zip(starts.tolist(), self.trees, strict=False):
            feature = np.array(t.feature)
            inner = feature >= 0
            np.add.at(gains, feature[inner], np.array(t.gain)[inner])
            parts["feature"].append(feature)
            parts["threshold"].append(np.array([self.edges[f][b] if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin, strict=True)]))
            parts["left"].append(np.array(t.left) + start)
            parts["right"].append(np.array(t.right) + start)
            parts["value"].append(self.leaves(t))
            parts["count"].append(np.array(t.h))
        parts["root"], parts["weight"] = [starts[:-1]], [np.full(len(self.trees), self.factor)]
        packed = {f"_{p}": np.concatenate([np.asarray(x, kind) for x in parts[p]] or [np.zeros(0, kind)]).tobytes() for p, kind in _PARTS.items()}
        return {"params": json.dumps(params, sort_keys=True), "n_trees": len(self.trees), "base": float(self.base), "gains": gains.tolist(), **packed}


def nodes_of(row) -> tuple[TreeNodes, float]:
    """Node arrays and base of a row of the model table."""
    return TreeNodes(**{p: np.frombuffer(row[f"_{p}"], kind) for p, kind in _PARTS.items()}), float(row["base"])


def _ensemble(kind: str, p: dict, edges, mean: float) -> Ensemble:
    if kind == "RandomForest":
        return Ensemble(0.0, 1.0 / p["trees"], [], edges, rule_of(kind, p), 1.0)
    return Ensemble(mean, p["rate"], [], edges, rule_of(kind, p), -1.0)


def bins_of(kind: str) -> int:
    return FOREST_BINS if kind == "RandomForest" else BOOSTED_BINS


def binned(kind: str, x: np.ndarray, held: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Edges of the rows that are not held out, and the codes of all."""
    edges = [bin_edges(x[:, k] if held is None else x[~held, k], bins_of(kind)) for k in range(x.shape[1])]
    return edges, bin_codes(x, edges)


def train_local(kind: str, p: dict, x: np.ndarray, y: np.ndarray, rows: np.ndarray, held: np.ndarray | None, seed: int, patience: int = PATIENCE,
                prepared: tuple[list[np.ndarray], np.ndarray] | None = None) -> Ensemble:
    """An ensemble of the rows of one task. ``rows`` are row numbers within the series, ``held`` marks rows that only say when boosting
    ends: after ``patience`` rounds without a smaller error, back to the round of the smallest. ``prepared``: what ``binned`` gives."""
    bins = bins_of(kind)
    fit = np.ones(len(y), bool) if held is None else ~held
    edges, codes = prepared or binned(kind, x, held)
    scale = target_scale(y)
    goal, local = np.rint(y * scale), LocalRows(codes[fit], bins, scale)
    out = _ensemble(kind, p, edges, int(goal[fit].sum()) / scale / max(1, int(fit.sum())))
    best, kept = np.inf, 0
    pred = np.full(len(y), out.base)
    for k in range(p["trees"]):
        h = weights_of(kind, p, rows[fit], k, seed)
        g = goal[fit] * h if kind == "RandomForest" else (np.rint(pred[fit] * scale) - goal[fit]) * h
        out.trees.append(local.tree(g, h, out.rule, columns_of(kind, p, x.shape[1], k, seed)))
        if kind == "RandomForest":
            continue
        pred = out.of_codes(codes, out.trees[-1:], pred)
        if held is not None and held.any():
            error = float(np.mean((pred[held] - y[held]) ** 2))
            if error < best:
                best, kept = error, k + 1
            if k + 1 - kept >= patience:
                break
    if kind != "RandomForest" and held is not None and held.any():
        out.trees = out.trees[:kept]
    return out


def last_rows(n: int) -> int:
    """Rows of a tenth of a series, 5 to 100; none under 20 rows."""
    return 0 if n < 20 else min(100, max(5, int(n * 0.1)))


def holdout(n: int) -> np.ndarray | None:
    """The last tenth of a series, 5 to 100 rows; None under 20 rows."""
    return None if n < 20 else np.arange(n) >= n - last_rows(n)


class SeriesTreeModel:
    """A fitted ensemble per series; ``table`` has a row for each."""

    statistical = False

    def __init__(self, name: str, table: DataFrame, features: Sequence[str], series: str = "series_id") -> None:
        self.name, self.table, self.features, self.series = name, table, list(features), series

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Predictions for rows of known series. Rows of a series are dealt over tasks, each of which gets the series' trees once."""
        series, features = self.series, self.features
        sizes = df.groupBy(series).agg(F.ceil(F.count(F.lit(1)) / F.lit(PREDICT_ROWS)).alias("_buckets"))
        rows = df.join(sizes, series).withColumn("_bucket", F.pmod(F.xxhash64(*features), F.col("_buckets"))).drop("_buckets")
        models = self.parameters().join(rows.select(series, "_bucket").distinct(), series).withColumnsRenamed({series: "_series", "_bucket": "_part"})
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.drop(columns="_bucket")
            if not len(right) or not len(left):
                return left.head(0).assign(**{out: pd.Series(dtype=float)})
            nodes, base = nodes_of(right.iloc[0])
            return left.assign(**{out: base + nodes.predict(left[features].to_numpy(dtype=float))})

        return rows.groupBy(series, "_bucket").cogroup(models.groupBy("_series", "_part")).applyInPandas(run, schema)

    def parameters(self) -> DataFrame:
        return self.table.select(self.series, "base", *[f"_{p}" for p in _PARTS])

    def matrix_scorer(self) -> Callable:
        def score(x, own):
            nodes, base = nodes_of(own)
            return base + nodes.predict(x)

        return score

    def panel_scorer(self) -> Callable:
        """Scores a row each of many series at once: the trees of all of them as one set of nodes."""
        def prepare(rows: pd.DataFrame):
            held = [nodes_of(r) for _, r in rows.iterrows()]
            start = np.cumsum([0, *(len(n.value) for n, _ in held)])
            most = max((len(n.root) for n, _ in held), default=0)
            root, weight = np.zeros((len(held), most), np.int64), np.zeros((len(held), most))
            for k, (n, _) in enumerate(held):
                root[k, :len(n.root)], weight[k, :len(n.root)] = n.root + start[k], n.weight
                root[k, len(n.root):] = min(start[k], start[-1] - 1)  # of no weight
            join = lambda part, move: np.concatenate([getattr(n, part) + (start[k] if move else 0) for k, (n, _) in enumerate(held)])
            feature, threshold, value = join("feature", False), join("threshold", False), join("value", False)
            left, right, base = join("left", True), join("right", True), np.array([b for _, b in held])

            def score(x: np.ndarray) -> np.ndarray:
                at, each = root, np.arange(len(x))[:, None]
                while (inner := feature[at] >= 0).any():
                    goes_left = x[each, np.maximum(feature[at], 0)] <= threshold[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                return base + (value[at] * weight).sum(1)

            return score

        return prepare

    def importances(self) -> DataFrame:
        """Share of all gains by series and feature; they sum to one where a tree has a split."""
        pair = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in self.features]).alias("feature"), F.col("gains").alias("gain"))).alias("e")
        total = F.aggregate("gains", F.lit(0.0), lambda a, g: a + g)
        return self.table.select(self.series, total.alias("total"), pair).select(
            self.series, F.col("e.feature").alias("feature"), F.coalesce(F.try_divide("e.gain", "total"), F.lit(0.0)).alias("importance"))

    def save(self, path: str) -> None:
        self.table.withColumn("features", F.lit(self.features).cast("array<string>")).withColumn("name", F.lit(self.name)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, series: str = "series_id") -> SeriesTreeModel:
        table = spark.read.parquet(path)
        info = table.select("name", "features").first()
        return cls(info["name"], table.drop("features", "name"), list(info["features"]), series)


def _schema(df: DataFrame, series: str, extra: str) -> T.StructType:
    return T.StructType([df.schema[series], *T._parse_datatype_string(extra).fields])


def _arrays(pdf: pd.DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("_i")
    return pdf[features].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float), pdf["_i"].to_numpy()


def _searched(rows: DataFrame, kind: str, candidates: list[dict], features, target, series, seed) -> DataFrame:
    """(series, params): the settings of each series with the smallest mean error over three contiguous folds. Each
    candidate and fold of a series is a task of its own."""
    folded = rows.withColumn("_fold", F.floor(F.col("_i") * 3 / F.col("_n")).cast("int"))
    jobs = F.explode(F.sequence(F.lit(0), F.lit(3 * len(candidates) - 1)))
    many = folded.select(series, "_i", target, *features, "_fold", jobs.alias("_job"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        number, fold = divmod(int(pdf["_job"].iloc[0]), 3)
        x, y, at = _arrays(pdf, features, target)
        out = (pdf["_fold"] == fold).to_numpy()
        if out.all() or not out.any():
            return pd.DataFrame({series: [], "number": [], "error": []})
        made = train_local(kind, candidates[number], x[~out], y[~out], at[~out], None, seed)
        error = float(np.sqrt(np.mean((made.of_codes(bin_codes(x[out], made.edges)) - y[out]) ** 2)))
        return pd.DataFrame({series: [pdf[series].iloc[0]], "number": [number], "error": [error]})

    errors = many.groupBy(series, "_job").applyInPandas(run, _schema(rows, series, "number int, error double"))
    best = errors.groupBy(series, "number").agg(F.round(F.avg("error"), 9).alias("error")).groupBy(series).agg(F.min(F.struct("error", "number")).alias("b"))
    names = F.array(*[F.lit(json.dumps(c)) for c in candidates])
    return best.select(series, names[F.col("b.number")].alias("_params"))


def _trained(pdf: pd.DataFrame, kind, chosen, features, target, series, seed, trials, ranges) -> pd.DataFrame:
    """Model row of one series."""
    x, y, at = _arrays(pdf, features, target)
    p = {**chosen, **(json.loads(pdf["_params"].iloc[0]) if "_params" in pdf and pdf["_params"].iloc[0] else {})}
    last = None if kind == "RandomForest" else holdout(len(y))
    prepared = binned(kind, x, last)
    if trials:
        past: list[tuple[dict, float]] = []
        for _ in range(trials):
            trial = {**chosen, **propose(ranges, past, seed)}
            made = train_local(kind, trial, x, y, at, last, seed, TRIAL_PATIENCE, prepared)
            own = slice(None) if last is None else last
            past.append((trial, float(np.sqrt(np.mean((made.of_codes(prepared[1][own]) - y[own]) ** 2)))))
        p = min(past, key=lambda t: t[1])[0]
    made = train_local(kind, p, x, y, at, last, seed, prepared=prepared)
    return pd.DataFrame([{series: pdf[series].iloc[0], **made.row(p)}])


def fit_series(
    train: DataFrame, features: Sequence[str], kind: str, chosen: dict, *, candidates: list[dict] | None = None, trials: int = 0,
    ranges: dict[str, Range] = BOOSTED_B_RANGES, target: str = "y", series: str = "series_id", ts: str = "ts", seed: int = 42, group_rows: int = MAX_GROUP_ROWS,
) -> SeriesTreeModel:
    """An ensemble of its own for every series. ``candidates`` are compared first by folds, ``trials`` from ``ranges`` one after another.

    Series over ``group_rows`` rows are searched and grown over all tasks, one series after another, with the same result."""
    features = list(features)
    numbered = reliable(positions(train.select(series, ts, target, *features), [series], [ts], pos="_i", total="_n"))
    small = numbered.filter(F.col("_n") <= group_rows)
    rows = small
    if candidates:
        best = reliable(_searched(small, kind, [{**chosen, **c} for c in candidates], features, target, series, seed))
        rows = small.join(best, series, "left")
    run = lambda pdf: _trained(pdf, kind, chosen, features, target, series, seed, trials, ranges)
    table = rows.groupBy(series).applyInPandas(run, _schema(train, series, MODEL_SCHEMA))
    long = [r[0] for r in numbered.filter(F.col("_n") > group_rows).groupBy(series).count().select(series).collect()]  # each has over group_rows rows
    for one in long:
        own = numbered.filter(F.col(series).eqNullSafe(F.lit(one)))
        row = _trained_long(own, kind, chosen, candidates, features, target, seed, trials, ranges)
        table = table.unionByName(train.sparkSession.createDataFrame([{series: one, **row}], _schema(train, series, MODEL_SCHEMA)))
    return SeriesTreeModel(kind, reliable(table), features, series)


def fit_series_forest(train: DataFrame, features: Sequence[str], *, params: dict | None = None, tune: bool = True, draws: int = 10,
                      grid: dict | None = None, seed: int = 42, **kw) -> SeriesTreeModel:
    """A random forest per series; by default after a random search over the grid."""
    chosen = {**FOREST_DEFAULTS, **(params or {})}
    return fit_series(train, features, "RandomForest", chosen, candidates=draw(grid or FOREST_GRID, draws, seed) if tune else None, seed=seed, **kw)


def fit_series_boosted_a(train: DataFrame, features: Sequence[str], *, params: dict | None = None, tune: bool = True, draws: int = 10,
                         grid: dict | None = None, seed: int = 42, **kw) -> SeriesTreeModel:
    """Second-order boosting per series, level by level: gain and leaf value from sums of gradients and weights with L2, samples of rows
    and columns per tree, an end when the newest rows do not get better. By default after a random search."""
    chosen = {**BOOSTED_A_DEFAULTS, **(params or {})}
    return fit_series(train, features, "BoostedA", chosen, candidates=draw(grid or BOOSTED_A_GRID, draws, seed) if tune else None, seed=seed, **kw)


def fit_series_boosted_b(train: DataFrame, features: Sequence[str], *, params: dict | None = None, tune: bool = True, trials: int = TRIALS,
                         seed: int = 42, **kw) -> SeriesTreeModel:
    """Boosting per series by the best leaf of each tree, up to a number of leaves; by default after a sequential search."""
    chosen = {**BOOSTED_B_DEFAULTS, **(params or {})}
    return fit_series(train, features, "BoostedB", chosen, trials=trials if tune else 0, seed=seed, **kw)


def _edges(fit: DataFrame, n: int, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Bin edges of n rows of a long series, as ``bin_edges`` gives them: values are numbered in their order by feature, and those at the
    wanted places reach the driver."""
    values = fit.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("k", "x"))
    ranked = positions(values, ["k"], ["x"], pos="_p", plan="plain" if n <= MAX_GROUP_ROWS else "chunked")
    places = {int(-(-n * j // bins) - 1) for j in range(1, bins)} - {-1}
    found: dict[int, dict[int, float]] = {k: {} for k in range(len(features))}
    for r in ranked.filter(F.col("_p").isin([*places | {n - 1}])).collect():
        found[r["k"]][r["_p"]] = r["x"]
    edges = [np.unique([own[at] for at in sorted(places)]) for own in found.values()]
    return [e[e < own[n - 1]] for e, own in zip(edges, found.values(), strict=True)]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


_CODED = "i long, y double, codes binary, pred array<double>"


def _states(batch: pa.RecordBatch, d: int, scale: float, shapes: Sequence[Ensemble], since: Sequence[Sequence[Tree]]):
    """Row numbers, codes, whole targets, and a function that gives the predictions of one of the ensembles: those written with the rows
    and the trees since."""
    codes, goal = _matrix(batch.column(2), d), np.rint(batch.column(1).to_numpy() * scale)
    held = batch.column(3).flatten().to_numpy().reshape(-1, len(shapes))
    return batch.column(0).to_numpy(), codes, goal, lambda e: shapes[e].of_codes(codes, since[e], held[:, e])


class _Long:
    """A series that no task can hold. Its rows numbered from ``low`` to under ``high`` are held out; the others give edges and trees.

    Ensembles of several settings grow side by side: a job over all rows serves the open nodes of all of them. The driver has their
    trees and gets a row per open node, never rows of the series but the last ones that end boosting."""

    def __init__(self, rows: DataFrame, n: int, low: int, high: int, kind: str, features: Sequence[str], target: str, seed: int, scaled_by_all: bool) -> None:
        self.spark, self.kind, self.seed, self.d, self.bins = rows.sparkSession, kind, seed, len(features), bins_of(kind)
        self.most = max(1, CELLS // (self.d * self.bins))  # open nodes of a job
        self.low, self.high, self.inside = low, high, (F.col("i") < low) | (F.col("i") >= high)
        fit = rows.filter((F.col("_i") < low) | (F.col("_i") >= high))
        n_fit = n - (high - low)
        self.edges = edges = _edges(fit, n_fit, features, self.bins)
        self.scale = target_scale(np.array([(rows if scaled_by_all else fit).agg(F.max(F.abs(target))).first()[0]]))
        self.mean = fit.agg(F.sum(F.rint(F.col(target) * self.scale).cast("long"))).first()[0] / self.scale / n_fit

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([b.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(edges))], 1)
                packed = pa.array([r.tobytes() for r in np.ascontiguousarray(bin_codes(x, edges).astype(np.uint8))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["i", "y", "codes"])

        given = rows.select("_i", F.col(target).cast("double"), *[F.col(f).cast("double") for f in features])
        self.table = reliable(given.mapInArrow(coded, "i long, y double, codes binary"))

    def ensembles(self, settings: Sequence[dict]) -> tuple[list[Ensemble], list[Ensemble], DataFrame]:
        """Ensembles without trees, the same without edges as tasks need them, and rows with the predictions of each."""
        made = [_ensemble(self.kind, p, self.edges, self.mean) for p in settings]
        shapes = [Ensemble(m.base, m.factor, [], [], m.rule, m.sign) for m in made]
        return made, shapes, self.table.withColumn("pred", F.array_repeat(F.lit(float(made[0].base)), len(made)))

    def _summed(self, table: DataFrame, shared, settings: Sequence[dict], at: Sequence[tuple[int, int]], shape: tuple[int, ...], run: Callable, schema: str) -> DataFrame:
        """Sums of a job's tasks. ``at``: (ensemble, number) of every tree; ``run`` adds a batch to an array of ``shape``, from its codes and
        a function that gives the whole gradients times weights, and the weights, of a tree."""
        kind, seed, scale, d = self.kind, self.seed, self.scale, self.d
        names = [c.split()[0] for c in schema.split(", ")][:-2]

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shapes, since, _, _ = shared.value
            total = np.zeros(shape)
            for b in batches:
                rows, codes, goal, predicted = _states(b, d, scale, shapes, since)
                known: dict[int, np.ndarray] = {}

                def gradients(t: int) -> tuple[np.ndarray, np.ndarray]:
                    e, number = at[t]
                    if e not in known:
                        known[e] = goal if kind == "RandomForest" else np.rint(predicted(e) * scale) - goal  # noqa: B023
                    h = weights_of(kind, settings[e], rows, number, seed)  # noqa: B023
                    return known[e] * h, h  # noqa: B023

                run(shared.value, total, codes, gradients)
            places = np.nonzero(total[..., 1])
            sums = [pa.array(total[..., k][places].astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in places], *sums], [*names, "g", "h"])

        return table.filter(self.inside).mapInArrow(tasks, schema).groupBy(*names).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def roots(self, table, shapes, since, settings, at: list[tuple[int, int]]) -> list[tuple[float, float]]:
        """Sums of all rows in every tree."""
        shared = self.spark.sparkContext.broadcast((shapes, since, None, None))

        def run(_, total, codes, gradients):
            for t in range(len(at)):
                total[t] += [v.sum() for v in gradients(t)]

        found = self._summed(table, shared, settings, at, (len(at), 2), run, "k long, g long, h long").collect()
        shared.destroy()
        by = {r["k"]: (r["g"] / self.scale, float(r["h"])) for r in found}
        return [by.get(k, (0.0, 0.0)) for k in range(len(at))]

    def splits(self, table, shapes, since, settings, at: list[tuple[int, int]], trees: list[Tree], nodes: list[tuple[int, int]]) -> dict[tuple[int, int], Split]:
        """Best splits of open nodes (place in ``trees``, node; those of a tree follow each other), from one job over all rows."""
        d, bins, scale = self.d, self.bins, self.scale
        shared = self.spark.sparkContext.broadcast((shapes, since, trees, nodes))

        def run(given, total, codes, gradients):
            _, _, trees, nodes = given
            start = 0
            for t, own in groupby(nodes, lambda n: n[0]):
                own = [node for _, node in own]
                (g, h), slot = gradients(t), np.full(len(trees[t].g), -1)
                slot[own] = np.arange(len(own))
                mine = slot[trees[t].walk(codes)]
                used = np.flatnonzero((mine >= 0) & (h > 0))
                if len(used):
                    total[start:start + len(own)] += histograms(codes[used], mine[used], g[used], h[used], len(own), bins)
                start += len(own)

        sums = self._summed(table, shared, settings, at, (len(nodes), d, bins, 2), run, "slot long, feature long, bin long, g long, h long")
        w = Window.partitionBy("slot", "feature")
        running = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        as_left = lambda c, win: (F.sum(c).over(win)).cast("double")
        cum = sums.select("slot", "feature", "bin", (as_left("g", running) / scale).alias("gl"), as_left("h", running).alias("hl"),
                          (as_left("g", w) / scale).alias("g"), as_left("h", w).alias("h"))
        rules = []
        for k, (t, _) in enumerate(nodes):
            e, number = at[t]
            rule, allowed = shapes[e].rule, columns_of(self.kind, settings[e], d, number, self.seed)
            rules.append((k, float(rule.l2), float(rule.least_rows), float(rule.split_rows), float(rule.least_gain), None if allowed is None else np.flatnonzero(allowed).tolist()))
        cum = cum.join(F.broadcast(self.spark.createDataFrame(rules, "slot long, l2 double, least_rows double, split_rows double, least_gain double, allowed array<long>")), "slot")
        gl, hl, g, h, l2, least = (F.col(c) for c in ("gl", "hl", "g", "h", "l2", "least_rows"))
        side = lambda g, h: F.try_divide(g * g, h + l2)
        good = (hl >= least) & (h - hl >= least) & (h - hl > 0) & (h >= F.col("split_rows")) & (F.col("allowed").isNull() | F.array_contains("allowed", F.col("feature")))
        cum = cum.filter(good).withColumn("gain", side(gl, hl) + side(g - gl, h - hl) - side(g, h)).filter("gain > least_gain")
        best = cum.groupBy("slot").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl")).alias("s")).collect()
        shared.destroy()
        return {nodes[r["slot"]]: Split(r["s"]["gain"], -r["s"]["f"], -r["s"]["b"], r["s"]["gl"], r["s"]["hl"]) for r in best}

    def forest(self, p: dict) -> Ensemble:
        """Trees that do not depend on each other, as many side by side as tasks may hold roots of."""
        (made,), shapes, table = self.ensembles([p])
        for start in range(0, p["trees"], self.most):
            at = [(0, k) for k in range(start, min(p["trees"], start + self.most))]
            made.trees += self._grow(table, shapes, [[]], [p], at)
        return made

    def _grow(self, table, shapes, since, settings, at: list[tuple[int, int]]) -> list[Tree]:
        """Trees (ensemble, number) level by level, or leaf by leaf, side by side."""
        steps = [growing(root, shapes[e].rule) for (e, _), root in zip(at, self.roots(table, shapes, since, settings, at), strict=True)]
        done: list[Tree | None] = [None] * len(at)
        asked: dict[int, tuple[Tree, list[int]]] = {}

        def go(t: int, answer: list[Split | None] | None) -> None:
            try:
                asked[t] = steps[t].send(answer)
            except StopIteration as end:
                done[t] = end.value
                asked.pop(t, None)

        for t in range(len(at)):
            go(t, None)
        while asked:
            trees = [asked[t][0] if t in asked else Tree() for t in range(len(at))]
            nodes, found = [(t, node) for t, (_, nodes) in sorted(asked.items()) for node in nodes], {}
            for k in range(0, len(nodes), self.most):
                found |= self.splits(table, shapes, since, settings, at, trees, nodes[k:k + self.most])
            for t, (_, nodes) in list(asked.items()):
                go(t, [found.get((t, node)) for node in nodes])
        return done

    def boosted(self, settings: Sequence[dict], patience: int | None) -> tuple[list[Ensemble], list[float]]:
        """Ensembles of several settings, a round of each at a time. With ``patience`` rows held out say when boosting ends, and the
        errors are those of the rounds kept; else errors over the rows held out, or over all where there are none."""
        made, shapes, table = self.ensembles(settings)
        written, best, kept = [0] * len(made), [np.inf] * len(made), [0] * len(made)
        stops = patience is not None and self.high > self.low
        if stops:
            tail = self.table.filter(~self.inside).orderBy("i").toArrow()  # at most 100 rows
            y, codes = tail["y"].to_numpy(), _matrix(tail["codes"].combine_chunks(), self.d)
            pred = [np.full(len(y), m.base) for m in made]
        growing_on, first = list(range(len(made))), table
        for k in range(max(p["trees"] for p in settings)):
            growing_on = [e for e in growing_on if k < settings[e]["trees"]]
            if not growing_on:
                break
            since = [m.trees[w:] for m, w in zip(made, written, strict=True)]
            for e, tree in zip(growing_on, self._grow(table, shapes, since, settings, [(e, k) for e in growing_on]), strict=True):
                made[e].trees.append(tree)
            for e in list(growing_on) if stops else []:
                pred[e] = shapes[e].of_codes(codes, made[e].trees[-1:], pred[e])
                error = float(np.mean((pred[e] - y) ** 2))
                if error < best[e]:
                    best[e], kept[e] = error, k + 1
                if k + 1 - kept[e] >= patience:
                    growing_on.remove(e)
            if growing_on and (k + 1) % WRITE_ROUNDS == 0:
                new = _advanced(table, shapes, [m.trees[w:] for m, w in zip(made, written, strict=True)], self.d)
                table, written = reliable(new) if table is first else replaced(new, table), [len(m.trees) for m in made]
        if stops:
            for m, k in zip(made, kept, strict=True):
                m.trees = m.trees[:k]
            return made, [float(np.sqrt(b)) for b in best]
        return made, self.errors(table, made, shapes, written)

    def errors(self, table: DataFrame, made: Sequence[Ensemble], shapes: Sequence[Ensemble], written: Sequence[int]) -> list[float]:
        """Root of the mean squared error of every ensemble over the rows held out, or over all where there are none."""
        d, shared = self.d, self.spark.sparkContext.broadcast((shapes, [m.trees[w:] for m, w in zip(made, written, strict=True)]))

        def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shapes, since = shared.value
            for b in batches:
                predicted, y = _states(b, d, 1.0, shapes, since)[3], b.column(1).to_numpy()
                sums = [float(((predicted(e) - y) ** 2).sum()) for e in range(len(shapes))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(shapes))), pa.array(sums), pa.array([len(y)] * len(shapes))], ["e", "s", "n"])

        rows = table.filter(~self.inside) if self.high > self.low else table
        found = rows.mapInArrow(squares, "e long, s double, n long").groupBy("e").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        shared.destroy()
        return [float(np.sqrt(r["s"] / r["n"])) for r in sorted(found, key=lambda r: r["e"])]


def _searched_long(rows: DataFrame, n: int, kind: str, candidates: list[dict], features, target, seed) -> dict:
    """The candidate with the smallest mean error over three contiguous folds."""
    errors: list[list[float]] = [[] for _ in candidates]
    for fold in range(3):
        low, high = -(-fold * n // 3), -(-(fold + 1) * n // 3)
        if low == high or high - low == n:
            continue
        data = _Long(rows, n, low, high, kind, features, target, seed, False)
        if kind == "RandomForest":
            for own, c in zip(errors, candidates, strict=True):
                made = data.forest(c)
                _, shapes, table = data.ensembles([c])
                own += data.errors(table, [made], shapes, [0])
        else:
            for own, error in zip(errors, data.boosted(candidates, None)[1], strict=True):
                own.append(error)
    ranked = [(round(float(np.mean(e)), 9), k) for k, e in enumerate(errors) if e]
    return candidates[min(ranked)[1]] if ranked else {}


def _trained_long(rows: DataFrame, kind: str, chosen: dict, candidates: list[dict] | None, features, target, seed, trials, ranges) -> dict:
    """Model row of one series that no task can hold, without its name: what ``_searched`` and ``_trained`` give for others."""
    n = rows.count()
    p = {**chosen, **(_searched_long(rows, n, kind, [{**chosen, **c} for c in candidates], features, target, seed) if candidates else {})}
    data = _Long(rows, n, n if kind == "RandomForest" else n - last_rows(n), n, kind, features, target, seed, True)
    if kind == "RandomForest":
        return data.forest(p).row(p)
    if trials:
        # the first ones are drawn, whatever came before
        drawn = [{**chosen, **propose(ranges, [({}, 0.0)] * k, seed)} for k in range(min(trials, RANDOM_TRIALS))]
        past = list(zip(drawn, data.boosted(drawn, TRIAL_PATIENCE)[1], strict=True))
        while len(past) < trials:
            trial = {**chosen, **propose(ranges, past, seed)}
            past.append((trial, data.boosted([trial], TRIAL_PATIENCE)[1][0]))
        p = min(past, key=lambda t: t[1])[0]
    return data.boosted([p], PATIENCE)[0][0].row(p)


def _advanced(held: DataFrame, shapes: Sequence[Ensemble], since: Sequence[Sequence[Tree]], d: int) -> DataFrame:
    """Rows of a long series with the predictions of the newest trees of every ensemble added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            predicted = _states(b, d, 1.0, shapes, since)[3]
            pred = np.stack([predicted(e) for e in range(len(shapes))], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pred) + 1, dtype=np.int32) * len(shapes)), pa.array(pred.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["i", "y", "codes", "pred"])

    return held.mapInArrow(run, _CODED)
