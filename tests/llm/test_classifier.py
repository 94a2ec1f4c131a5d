"""The quality classifier against a plain discriminant, and on documents that it has not seen."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from wattline.llm import classifier

from . import brute
from .data import awkward, empty, order


def odds(part, whole):
    share = part / whole if whole else 0.0
    return math.log((share + 0.01) / (1 - share + 0.01))


def plain_statistics(text):
    """The statistics one by one, from characters and words."""
    text = text or ""
    data = text.encode()
    words = [w.encode() for w in brute.words(text)]
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    lines = [x for x in text.split("\n") if brute.words(x)]
    among = lambda kind: sum(1 for b in data if b < 128 and re.fullmatch(kind, chr(b)))
    share = [c / len(data) for c in Counter(data).values()]
    base = brute.base_counts(text)
    out = [math.log1p(len(text)), math.log1p(len(words)), math.log1p(mean), math.log1p(math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))),
           odds(among("[A-Z]"), among("[A-Za-z]")), odds(among("[0-9]"), len(data)), odds(among(r"[.,;:!?'\"()-]"), len(data)),
           odds(among(r"[#$%&*+/<=>@\[\\\]^_`{|}~]"), len(data)), odds(among(r"[ \t\n\x0b\f\r]"), len(data)), odds(sum(b > 127 for b in data), len(data)),
           -sum(s * math.log2(s) for s in share), odds(len(set(words)), len(words)), odds(max(Counter(words).values(), default=0), len(words)),
           odds(base[4], len(words)), odds(len(lines) - len(set(lines)), len(lines)), math.log1p(len(words) / max(1, len(lines))),
           odds(sum(x == 1 for x in lengths) if words else 0, len(words))]
    return np.round(np.array(out) * 4096) / 4096


def plain_scores(x, label):
    """Probability of label 1 by densities with solved systems and determinants; label -1: not used in the fit."""
    pooled = sum((label == k).sum() * np.cov(x[label == k].T, bias=True) for k in (0, 1)) / (label >= 0).sum()
    log = []
    for k in (0, 1):
        own = x[label == k]
        held = 0.75 * np.cov(own.T, bias=True) + 0.2 * pooled + 0.05 * np.diag(np.diag(pooled)) + 0.01 * np.eye(x.shape[1])
        away = x - own.mean(0)
        log.append(math.log(len(own) / (label >= 0).sum()) - 0.5 * np.linalg.slogdet(held)[1] - 0.5 * (away * np.linalg.solve(held, away.T).T).sum(1))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def tables(spark, folder):
    return [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]


def test_equals_the_plain_version(spark, sf001):
    docs, labels = tables(spark, sf001)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.collect()
    x = np.array([plain_statistics(r.text) for r in rows])
    assert np.abs(x - np.array([classifier.statistics(r.text or "") for r in rows]) / 4096).max() <= 1 / 4096
    held_out = [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    label = np.array([-1 if h else known.get(r.doc_id, -1) for r, h in zip(rows, held_out, strict=True)])
    want = dict(zip([r.doc_id for r in rows], zip(held_out, plain_scores(x, label), strict=True), strict=True))
    got = queries()["op12_quality_classifier"](spark, sf001).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        assert r.held_out == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3 and r.predicted == (r.score >= 0.3)
    assert got == queries()["op12_quality_classifier"](spark, sf001).collect()


def test_unseen_documents(spark, sf01):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in queries()["op12_quality_classifier"](spark, sf01).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and np.mean([a == b for a, b in rows]) > 0.97


def test_labels_of_a_hot_document(spark, sf001):
    """Rows of one identifier for a third of the table, labels that differ, are null or of another value."""
    docs, labels = tables(spark, sf001)
    some = labels.limit(1).collect()[0]
    own = docs.filter(F.col("doc_id") == some.doc_id)
    hot = docs.union(own.withColumn("many", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("many"))
    rows = classifier.measured(hot)
    model = classifier.fit(rows, labels)
    x = np.array([classifier.statistics(r.text or "") for r in hot.collect()]) / 4096
    known = {r.doc_id: r.quality for r in labels.collect()}
    label = np.array([known.get(r.doc_id, -1) for r in hot.collect()])
    assert np.abs(model.score(x * 4096) - plain_scores(x, label)).max() < 1e-6
    odd = labels.union(spark.createDataFrame([(some.doc_id, 1 - some.quality, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)], labels.schema))
    without = classifier.fit(rows, odd.filter("doc_id is not null"))
    label[[r.doc_id == some.doc_id for r in hot.collect()]] = -1
    got, want = without.score(x * 4096), plain_scores(x, label)
    assert np.abs(got - want).max() < 1e-6


@pytest.mark.parametrize("rows", [awkward, empty])
def test_awkward_rows(spark, sf001, rows):
    docs, labels = rows(spark), spark.read.parquet(f"{sf001}/labels.parquet")
    got = classifier.classified(docs, labels)
    assert got.columns == [*docs.columns, "quality_score", "quality_predicted"]
    assert order([tuple(r)[:-2] for r in got.collect()]) == order([tuple(r) for r in docs.collect()])
    twice = classifier.classified(got, labels)
    assert twice.columns[-2:] == ["quality_score_1", "quality_predicted_1"]
    one = classifier.classified(docs, labels.filter("quality = 1"))
    assert {r.quality_score for r in one.collect()} <= {0.5, 1.0}
    assert {r.quality_score for r in classifier.classified(docs, labels.limit(0)).collect()} <= {0.5}


def test_a_label_without_rows():
    d = len(classifier.STATISTICS)
    moments = np.zeros((2, 1 + d + d * d), object)
    assert classifier.discriminant(moments) is None
    x = np.stack([classifier.statistics(t) for t in ("", "a b c", "Some words here.")])
    moments[1] = [3, *map(int, x.sum(0)), *map(int, (x.T @ x).ravel())]
    assert classifier.discriminant(moments).score(x).tolist() == [1.0, 1.0, 1.0]
