"""Quality rules and a hashed n-gram likelihood ratio."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

# Byte n-grams are hashed to this many buckets, which bounds the model at any size of the corpus.
NGRAM = 4
BUCKET_BITS = 18
# Bound of the trusted sample: labelled documents of quality 1 that are not toxic.
TRUSTED_DOCS = 20_000
# n-grams' worth of the corpus itself that is mixed into the target's counts.
PRIOR = 10_000.0
# A text stays if its mean log ratio per n-gram is at least this.
THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def buckets(text: bytes) -> np.ndarray:
    """Bucket of every n-gram of a text, white space included."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = len(data) - NGRAM + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    gram = data[:n].copy()
    for k in range(1, NGRAM):
        gram = (gram << np.uint32(8)) | data[k:k + n]
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more, first occurrence included. Hashes find, words decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    if not equal.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]])).tolist()
    at = [(k, tuple(words[k:k + WINDOW])) for k in maybe]
    times = Counter(w for _, w in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for k, w in at:
        if times[w] > 1:
            edge[k] += 1
            edge[k + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode()
    words = data.split()  # bytes: the six ASCII white-space characters only
    blanks = len(data) - sum(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BUCKET_BITS
    counts = {False: np.zeros(size, np.int64), True: np.zeros(size, np.int64)}
    held: dict[bool, list[np.ndarray]] = {False: [], True: []}

    def flush() -> None:
        for kind, parts in held.items():
            if parts:
                counts[kind] += np.bincount(np.concatenate(parts), minlength=size)
                parts.clear()

    for batch in batches:
        waiting = 0
        for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[trusted].append(own := buckets((text or "").encode()))
            waiting += len(own)
            if waiting > 1 << 21:
                flush()
                waiting = 0
        flush()
    corpus = counts[False] + counts[True]
    used = np.flatnonzero(corpus)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(corpus[used]), pa.array(counts[True][used])], ["bucket", "corpus", "target"])


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_DOCS) -> DataFrame:
    """Identifiers of at most ``bound`` labelled documents of quality 1 that are not toxic, drawn by hash."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    n, top = good.count(), 1 << 30
    key = F.xxhash64("doc_id")
    drawn = good.filter(F.pmod(key, F.lit(top)) < min(top, -(-top * bound // max(1, n))))
    return drawn.orderBy(key, "doc_id").limit(bound)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = TRUSTED_DOCS) -> np.ndarray | None:
    """Log ratio per bucket between the trusted multinomial and that of all ``docs``; None without n-grams or trusted documents.

    Each task counts its texts to one array; a row per task and bucket is summed. The target takes PRIOR n-grams in the corpus's own
    proportions, so a bucket that the sample has not seen is not impossible, and the rule is the same at every size."""
    trusted = trusted_ids(labels, bound).select(F.col("doc_id").alias("trusted_id"))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # at most ``bound`` numbers are broadcast
    marked = plain.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    sums = marked.mapInArrow(_counter, "bucket long, corpus long, target long").groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target")).toArrow()
    corpus, target = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    corpus[sums["bucket"].to_numpy()], target[sums["bucket"].to_numpy()] = sums["corpus"].to_numpy(), sums["target"].to_numpy()
    if not corpus.sum() or not target.sum():
        return None
    share = corpus / corpus.sum()
    ratio = np.zeros(1 << BUCKET_BITS, np.float64)
    seen = share > 0
    ratio[seen] = np.log((target[seen] + PRIOR * share[seen]) / ((target.sum() + PRIOR) * share[seen]))
    return ratio


def log_ratio(text: str, ratio: np.ndarray | None) -> float:
    """Mean log ratio per n-gram; 0 for a text without n-grams or without a model."""
    held = buckets(text.encode()) if ratio is not None else ()
    return float(ratio[held].sum() / len(held)) if len(held) else 0.0


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, len(_BASE))
            score = np.array([log_ratio(t, ratio) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(base[:, k]) for k in range(len(_BASE))), pa.array(score)],
                                             [*batch.schema.names[:-1], *_BASE, "log_ratio"])

    return run


def score(docs: DataFrame, ratio: np.ndarray | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` with the base counts, base_failed, log_ratio and kept for every whole text.

    A null text has no words and fails. Rows repeat as they are; an empty table gives none. ``keep`` may not hold the new names."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # a number per bucket
    types = dict(docs.dtypes)
    fields = "".join(f"`{c}` {types[c]}, " for c in keep) + "".join(f"{c} long, " for c in _BASE) + "log_ratio double"
    found = docs.select(*keep, F.col(text).cast("string")).mapInArrow(_scorer(shared), fields)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def quality_filter(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    own, ids = fresh(docs, "quality_text"), fresh(docs, "quality_id")
    ratio = fit(docs, labels, doc_id, text)
    clashing = [c for c in docs.columns if c.lower() in {*_BASE, "log_ratio", "base_failed", "kept"}]
    inner = {c: (f"{ids}_{k}" if c in clashing else c) for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.col(text).cast("string").alias(own))
    found = score(plain, ratio, tuple(inner.values()), own, **options).filter("kept")
    return found.select([F.col(f"`{n}`").alias(c) for c, n in inner.items()])


def op10(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", *_BASE, "base_failed", "kept", "log_ratio")
