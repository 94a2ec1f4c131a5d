"""Language of texts by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
# Bounds of the labelled sample that the network is fitted on: documents of a language, and windows of a document.
SAMPLE_DOCS = 1000
SAMPLE_WINDOWS = 6
STEPS = 400
BATCH = 64
RATE = 0.02
UNKNOWN = "und"
# Windows that go through the network together.
STACK = 1024
_OVERLAP = max(WIDTHS) - 1


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 3 from the checksum of the identifier's digits; documents of fold 2 are held out. A null has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def windows(text: bytes) -> np.ndarray:
    """All of a text in rows of WINDOW bytes. Rows share the bytes that the widest filter spans; the last is padded with zeros."""
    step = WINDOW - _OVERLAP
    n = max(1, -(-(len(text) - _OVERLAP) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


@dataclass
class Network:
    """Filters of several widths over bytes, the largest response of each in a window, and a softmax over languages."""

    languages: list[str]
    filters: dict[int, np.ndarray]  # width: (width, 256, filters)
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def __post_init__(self):
        # A filter is a sum over byte positions, so pairs of neighbouring bytes have one table row each.
        self._pairs = {w: [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w - 1, 2)] for w, f in self.filters.items()}

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of each language for each window."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for k in range(0, len(rows), 64):  # so that responses stay in the processor's cache
            part = np.ascontiguousarray(rows[k:k + 64].T, np.intp)  # positions first: the maximum then runs over whole rows
            pair = (part[:-1] << 8) | part[1:]
            pooled = []
            for width, tables in self._pairs.items():
                n = WINDOW - width + 1
                response = tables[0].take(pair[:n], axis=0, mode="clip")
                for j, extra in enumerate(tables[1:], 1):
                    response += extra.take(pair[2 * j:2 * j + n], axis=0, mode="clip")
                if width % 2:
                    response += self.filters[width][-1].take(part[width - 1:width - 1 + n], axis=0, mode="clip")
                pooled.append(response.max(axis=0))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
            score = hidden @ self.weights + self.offset
            score = np.exp(score - score.max(1, keepdims=True))
            out[k:k + 64] = score / score.sum(1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of the highest mean probability over all windows of a text, and that mean. A text without letters is unknown,
        with score 0. Windows of all texts go through the network together, STACK of them at a time."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def close() -> None:
            counts = np.array([len(rows) for _, rows in held])
            sums = np.add.reduceat(self.probabilities(np.concatenate([rows for _, rows in held])).astype(np.float64), np.cumsum(counts) - counts)
            for (k, _), mean in zip(held, sums / counts[:, None], strict=True):
                best = int(mean.argmax())
                out[k] = self.languages[best], float(min(1.0, round(mean[best], 6)))
            held.clear()

        for k, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                held.append((k, windows(text.encode())))
                size += len(held[-1][1])
                if size >= STACK:
                    close()
                    size = 0
        if held:
            close()
        return out


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Fits the network with Adam on windows and their labels; languages weigh alike."""
    random = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    state = {f"f{w}": random.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    state |= {"bias": np.zeros(size, np.float32), "weights": random.normal(0, 0.2, (size, len(languages))).astype(np.float32), "offset": np.zeros(len(languages), np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in state.items()} for _ in range(2))
    members = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        at = np.concatenate([random.choice(m, -(-BATCH // len(members))) for m in members if len(m)])
        x, y = rows[at].astype(np.int64), labels[at]
        n, pooled, where = np.arange(len(at)), [], []
        for w in WIDTHS:
            response = sum(state[f"f{w}"][j].take(x[:, j:WINDOW - w + 1 + j], axis=0) for j in range(w))
            where.append(response.argmax(1))
            pooled.append(np.take_along_axis(response, where[-1][:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + state["bias"]
        hidden = np.maximum(raw, 0)
        score = hidden @ state["weights"] + state["offset"]
        score = np.exp(score - score.max(1, keepdims=True))
        error = score / score.sum(1, keepdims=True)
        error[n, y] -= 1
        error /= len(at)
        back = (error @ state["weights"].T) * (raw > 0)
        grads = {"weights": hidden.T @ error, "offset": error.sum(0), "bias": back.sum(0)}
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS:(k + 1) * FILTERS]
            grads[f"f{w}"] = g = np.zeros_like(state[f"f{w}"])
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, where[k] + j, 1), np.arange(FILTERS)[None, :]), own)
        for name, g in grads.items():
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g * g
            rate = RATE * (1 - 0.9 * step / steps)
            state[name] -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return Network(languages, {w: state[f"f{w}"] for w in WIDTHS}, state["bias"], state["weights"], state["offset"])


def _sampler(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys, rows = [], [], []
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = windows(text.encode())
                for k in sorted({i * (len(own) - 1) // max(1, count - 1) for i in range(count)}):  # spread over the whole text
                    langs.append(lang)
                    keys.append(key)
                    rows.append(own[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], ["lang", "key", "row"])

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS,
        window_count: int = SAMPLE_WINDOWS, steps: int = STEPS) -> Network | None:
    """Network from labelled rows of ``docs`` that are not held out; None if there is none.

    Of each language about ``per_language`` documents are drawn by the hash of doc_id and text, at most twice as many however often rows
    repeat, and ``window_count`` windows spread over each; this bounded sample alone reaches the driver, in an order of its own. Languages are as many
    as the labels name."""
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold() != 2, F.lit(False)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return None
    top = 1 << 30
    cuts = F.create_map(*[F.lit(v) for name, n in sorted(counts.items()) for v in (name, min(top, -(-top * per_language // n)))])
    drawn = usable.withColumn("key", F.xxhash64("doc_id", "text")).filter(F.pmod("key", F.lit(top)) < F.element_at(cuts, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id", "text"))
    drawn = drawn.withColumn("place", place).filter(F.col("place") <= 2 * per_language)
    rows = drawn.select("lang", "key", "text").mapInArrow(_sampler(window_count), "lang string, key long, row binary").toArrow()
    languages = sorted(counts)
    number = np.array([languages.index(v) for v in rows["lang"].to_pylist()])
    order = np.lexsort([number, rows["key"].to_numpy()])  # the same order in every run; windows of a document follow each other
    x = np.frombuffer(b"".join(rows["row"].to_pylist()), np.uint8).reshape(-1, WINDOW)[order]
    return train(x, number[order], languages, steps)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [(UNKNOWN, 0.0)] * len(texts) if network is None else network.predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred and score of every whole text. Texts that are null, empty or have no letters, and all texts without a
    network, are unknown with score 0. Rows repeat as they are; an empty table gives none; ``keep`` may not hold the new names. The network is about 20 MB at any size of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    types = dict(docs.dtypes)
    fields = "".join(f"`{c}` {types[c]}, " for c in keep) + "lang_pred string, score double"
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(_predictor(shared), fields)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
