"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, numbered, table
from .quality import repeated_words

STATISTICS = ("log_chars", "log_words", "log_word_length", "log_word_spread", "upper", "digits", "marks", "symbols", "blanks", "beyond_ascii",
              "entropy", "distinct_words", "top_word", "repeated_words", "repeated_lines", "log_words_a_line", "one_byte_words")
# Statistics are whole multiples of 1 / STEP, so their moments are sums of integers and do not depend on the order of rows.
STEP = 4096
# Shares become log odds with this much added to both sides.
ODDS = 0.01
# Shares of the pooled covariance and of its diagonal in the covariance of a class, and the least variance.
POOLED, DIAGONAL, LEAST_VARIANCE = 0.2, 0.05, 0.01
PREDICT = 0.3
_MARKS, _BLANKS = b".,;:!?'\"()-", b" \t\n\x0b\x0c\r"
_LETTERS = range(65, 91), range(97, 123)
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)


def _odds(part: float, whole: float) -> float:
    share = part / whole if whole else 0.0
    return float(np.log((share + ODDS) / (1 - share + ODDS)))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text as whole multiples of 1 / STEP; an empty text has no characters, words or lines."""
    data = text.encode()
    times = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda which: int(times[list(which)].sum())
    words = data.split()  # bytes: the six ASCII white-space characters only
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [line for line in data.split(b"\n") if line.strip()]
    own = Counter(words)
    share = times[times > 0] / max(1, len(data))
    upper, lower = count(_LETTERS[0]), count(_LETTERS[1])
    out = np.array([
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        _odds(upper, upper + lower), _odds(count(range(48, 58)), len(data)), _odds(count(_MARKS), len(data)), _odds(count(_SYMBOLS), len(data)),
        _odds(count(_BLANKS), len(data)), _odds(int(times[128:].sum()), len(data)), -float((share * np.log2(share)).sum()),
        _odds(len(own), len(words)), _odds(max(own.values(), default=0), len(words)), _odds(repeated_words(words), len(words)),
        _odds(len(lines) - len(set(lines)), len(lines)), np.log1p(len(words) / max(1, len(lines))), _odds(int((lengths == 1).sum()) if words else 0, len(words)),
    ])
    return np.rint(out * STEP).astype(np.int64)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [statistics(t or "").astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["doc_id", "statistics"])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table (doc_id, statistics, row, node), a row per row of ``docs``: packed statistics of every whole text, null as empty."""
    return numbered(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
                    .mapInArrow(_statistics, "doc_id long, statistics binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, len(STATISTICS)).astype(np.int64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, statistics) of a task as one row per label and moment: count, sums and sums of products."""
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d), np.int64)
    for batch in batches:
        label, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        for k in (0, 1):
            own = x[label == k]
            sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    at = np.tile(np.arange(sums.shape[1], dtype=np.int32), 2)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1]), pa.int32()), pa.array(at), pa.array(sums.ravel())], ["label", "at", "value"])


@dataclass
class Discriminant:
    """Means, inverses of the Cholesky factors of the covariances, and log weight less half the log determinant, for both labels."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        log_density = []
        for mean, factor, offset in zip(self.mean, self.factor, self.offset, strict=True):
            turned = (x / STEP - mean) @ factor.T
            log_density.append(offset - 0.5 * (turned * turned).sum(1) if np.isfinite(offset) else np.full(len(x), -np.inf))
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def discriminant(moments: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
    """The discriminant of exact moments (label, count and sums); None without labelled rows. A label without rows gets weight 0.

    Covariance of a label: its own, shrunk by ``pooled`` towards that of all rows about their label's mean, and by
    ``diagonal`` towards the latter's diagonal; LEAST_VARIANCE is added, so it has a Cholesky factor whatever the rows."""
    d = len(STATISTICS)
    n = np.array([float(m[0]) for m in moments])
    if not n.sum():
        return None
    mean, own = np.zeros((2, d)), np.zeros((2, d, d))
    for k in np.flatnonzero(n):
        first, count = [int(v) for v in moments[k][1:1 + d]], int(moments[k][0])
        # exact integers: n * sum of products - product of sums
        cross = np.array([[float(count * int(moments[k][1 + d + i * d + j]) - first[i] * first[j]) for j in range(d)] for i in range(d)])
        mean[k], own[k] = np.array(first, float) / count / STEP, cross / count ** 2 / STEP ** 2
    together = (n[:, None, None] * own).sum(0) / n.sum()
    factor, offset = np.zeros((2, d, d)), np.full(2, -np.inf)
    for k in np.flatnonzero(n):
        held = (1 - pooled - diagonal) * own[k] + pooled * together + diagonal * np.diag(np.diag(together)) + LEAST_VARIANCE * np.eye(d)
        lower = np.linalg.cholesky(held)
        factor[k], offset[k] = np.linalg.inv(lower), np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum()
    return Discriminant(mean, factor, offset)


def fit(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", **shrinkage) -> Discriminant | None:
    """Fits rows of ``measured`` to ``labels`` (doc_id and 0 or 1). Every labelled row counts; a document labelled both ways, and null or
    other labels, do not. Moments are summed per task and then per place, so the driver gets two rows per moment."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    joined = attach(rows, known, ["doc_id"]).filter("label is not null").select("label", "statistics")
    sums = joined.mapInArrow(_moments, "label int, at int, value long").groupBy("label", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    moments = np.zeros((2, 1 + len(STATISTICS) + len(STATISTICS) ** 2), object)
    for r in sums:
        moments[r["label"], r["at"]] = int(r["value"])
    return discriminant(moments, **shrinkage)


def score(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) for rows of ``measured``: the probability of label 1, to nine digits; 0.5 without a model.

    An empty table gives no rows; repeated rows score alike."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two matrices of the statistics

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, held = _matrix(batch.column(1)), shared.value
            out = np.full(len(x), 0.5) if held is None else held.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(out, 9))], ["doc_id", "score"])

    return rows.select("doc_id", "statistics").mapInArrow(run, "doc_id long, score double")


def classified(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = PREDICT) -> DataFrame:
    """The rows of ``docs`` with quality_score and quality_predicted (a number is added to a name that the table has), fitted to ``labels``.

    Every row is scored, those of null texts as empty ones; rows repeat as they are and keep their extra columns. An empty table gives no rows."""
    score_name, predicted = fresh(docs, "quality_score"), fresh(docs, "quality_predicted")
    row = fresh(docs, "quality_row")
    held = numbered(docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))))
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = measured(held, "row", place[text])
    ids = held.select(F.col("row").alias("doc_id"), F.col(place[doc_id]).cast("long").alias("known"))
    named = rows.join(ids, "doc_id").select(F.col("known").alias("doc_id"), "statistics", "node")
    found = score(rows, fit(named, labels, doc_id, label)).withColumnRenamed("doc_id", row)
    out = held.join(found, held["row"] == found[row])
    return out.select(*[F.col(p).alias(c) for c, p in place.items()], F.col("score").alias(score_name), (F.col("score") >= threshold).cast("int").alias(predicted))


def op12(spark, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(rows.filter(~held_out), table(spark, sf_dir, "labels"))
    return score(rows, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
