"""The pipeline and its stages against plain versions, and the columns of the registered queries."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from wattline.llm.common import file_system, reliable, scratch

from . import brute
from .data import awkward, empty, order

COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard", "op2": "doc_id keep_id group_size kept text_sha256", "op3": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id fingerprint component_id", "op5": "doc_id held_out lang_pred score", "op6": "page_id payload_bytes payload_digest record_type refers_to",
    "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "doc_id size source_size target taken",
    "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


def plain_run(rows, trusted):
    """(doc_id, text, source) rows to (doc_id, n_tokens, ids_sha256, decoded_sha256), repeats included."""
    ratios = brute.log_ratios([(d, t) for d, t, _ in rows], trusted)
    kept = []
    for row, ratio in zip(rows, ratios, strict=True):
        base = brute.base_counts(row[1])
        if base[0] >= 10 and 100 * base[4] <= 20 * base[0] and ratio >= -0.25:
            kept.append(row)
    kept = [r for r, e in zip(kept, brute.exact([r[:2] for r in kept]), strict=True) if e[3]]
    kept = brute.similar_rows(kept)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for (doc_id, text, _), m in zip(kept, brute.mix([(d, s, t) for d, t, s in kept]), strict=True):
        ids = library.encode_ordinary(text)
        out += [(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * int(m[4])
    return out


def test_pipeline(spark, sf001):
    labels = spark.read.parquet(f"{sf001}/labels.parquet").collect()
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    want = plain_run(rows, {r.doc_id for r in labels if r.quality == 1 and not r.toxic})
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf001).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len({r[0] for r in got}) > 50 and order(got) == order(want)


def test_scratch_tables_go(spark):
    before = reliable(spark.range(3))
    with scratch(spark):
        inner = reliable(spark.range(5))
        assert inner.count() == 5
    files = [df.inputFiles()[0] for df in (before, inner)]
    assert [file_system(f)[0].get_file_info(file_system(f)[1]).is_file for f in files] == [True, False] and before.count() == 3


@pytest.mark.parametrize("rows", [awkward, empty])
def test_stages_take_awkward_rows(spark, sf001, rows):
    docs = rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf001)
        if name != "token_ids":
            assert out.schema == docs.schema
        out.count()


def test_registered_queries(spark, sf001):
    known = queries()
    for number, columns in COLUMNS.items():
        (name,) = [q for q in known if q.startswith(number + "_")]
        assert set(columns.split()) <= set(known[name](spark, sf001).columns)
    assert {"op2_exact_dedup", "op6_warc", "op7_preferences", "op9_mixing"} <= set(oracle_sql())
    assert len([q for q in known if q.startswith("op7_")]) == 1 and "pipeline" in known
