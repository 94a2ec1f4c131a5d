"""Sharding, exact and near duplicates and mixing against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import exact_dedup, graph, mixing, quality, sharding, simhash
from wattline.llm.common import numbered, prefix_sums

from . import brute
from .data import awkward, empty, order


@pytest.fixture(scope="module")
def docs(spark, sf001):
    return spark.read.parquet(f"{sf001}/documents.parquet")


def tables(spark, docs):
    return [docs, awkward(spark), empty(spark)]


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_prefix_sums_of_a_hot_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"), (F.col("id") % 7).alias("k"), (F.col("id") % 5).alias("v"), "id")
    got = collected(prefix_sums(rows, ["k"], "v", ["g"]), "g", "k", "v", "before", "index", "total", "count")
    assert len(got) == 4000
    for g in ("hot", "cold", None):
        own = sorted((r for r in got if r[0] == g), key=lambda r: r[4])
        assert [r[4] for r in own] == list(range(len(own))) and all(r[6] == len(own) for r in own)
        assert [r[1] for r in own] == sorted(r[1] for r in own)
        assert [r[3] for r in own] == [0, *np.cumsum([r[2] for r in own])[:-1].tolist()] and {r[5] for r in own} == {sum(r[2] for r in own)}


def test_shards(spark, docs):
    for table in tables(spark, docs):
        plain = table.select("doc_id", sharding.text_size().alias("size"), F.lit(1).alias("slot"), F.lit(2).alias("index"), F.lit(3).alias("count"))
        got = collected(sharding.shards_by_bytes(plain), "doc_id", "size", "shard", "slot")
        want = brute.shards(collected(plain, "doc_id", "size"))
        assert sorted(map(str, ((r[0], r[2], r[3]) for r in got))) == sorted(map(str, ((r[0], r[2], r[3]) for r in want))) or table is not docs
        for s in range(16):
            own = sorted((r for r in got if r[2] == s), key=lambda r: r[3])
            assert [r[3] for r in own] == list(range(len(own)))
        ordered = sorted(got, key=lambda r: (r[2], r[3]))
        assert [brute.key(r[0]) for r in ordered] == sorted(brute.key(r[0]) for r in got)
        if got:
            sizes, total = [sum(r[1] for r in got if r[2] == s) for s in range(16)], sum(r[1] for r in got)
            assert max(abs(x - total / 16) for x in sizes) <= max(r[1] for r in got)


def test_shard_query_columns(spark, sf001, docs):
    rows = {r.doc_id: r for r in sharding.op1(spark, sf001).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        assert (rows[r.doc_id].size, rows[r.doc_id].text_crc32) == (len(data) + 1, brute.crc(data))
    assert {(r.law, r.grown_shard) for r in rows.values()} == {("bytes", None)}


def test_exact_duplicates(spark, docs):
    for table in tables(spark, docs):
        for fan_in in (2, 16):
            spread = table.select("doc_id", "text").repartition(7)
            found = exact_dedup.duplicates(exact_dedup.digested(spread), fan_in).withColumn("sha", F.lower(F.hex("digest")))
            got = collected(found, "id", "keep_id", "group_size", "kept", "sha")
            assert order(got) == order(brute.exact(collected(spread, "doc_id", "text")))


def test_runs_of_many_batches(spark, docs):
    """Entries that wait for the next batch, in batches of one to five rows."""
    for rows in (1, 5):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = collected(exact_dedup.duplicates(exact_dedup.digested(docs), 2), "id", "keep_id", "group_size", "kept")
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert order(got) == order(r[:4] for r in brute.exact(collected(docs, "doc_id", "text")))


def test_exact_dedup_keeps_columns_and_one_row(spark, docs):
    for table in tables(spark, docs):
        out = exact_dedup.dedup(table)
        assert out.schema == table.schema
        assert order(collected(out, "doc_id")) == order((r[0],) for r in brute.exact(collected(table, "doc_id", "text")) if r[3])


def test_a_run_out_of_order_is_found(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"node": [0, 0], "digest": [b"x" * 32] * 2, "bytes": [1, 1], "keep_id": [5, 4], "keep_row": [0, 1], "group_size": [1, 1]})
    with pytest.raises(AssertionError):
        list(exact_dedup.collapse(iter([batch])))


def test_fingerprints_and_groups(spark, docs):
    for table in tables(spark, docs):
        found = simhash.groups(numbered(simhash.fingerprints(table)))
        got = collected(found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id"), "id", "f", "component_id")
        assert order(got) == order(r[:3] for r in brute.near(collected(table, "doc_id", "text")))
        out = simhash.near_dedup(table)
        assert out.schema == table.schema
        assert order(collected(out, "doc_id")) == order((r[0],) for r in brute.near(collected(table, "doc_id", "text")) if r[3])


@pytest.mark.parametrize(("list_rows", "batch"), [(10, 10_000), (10, 7), (4096, 10_000), (4096, 50)])
def test_links_of_dense_fingerprints(spark, list_rows, batch):
    """Clusters around few centres; with short lists the split of long ones carries most links."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(120):
            fp = centre
            for _ in range(rng.randint(1, 7)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in fps)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    roots = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(5), list_rows)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute.linked([f % (1 << 64) for f in fps])
    assert [roots.get(f, f) for f in fps] == [fps[w] for w in want]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(300)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix(spark, docs):
    for table in tables(spark, docs):
        slim = numbered(table.select("doc_id", "source", mixing.word_count().alias("size"), "text")).drop("node")
        got = collected(mixing.mix(slim), "doc_id", "size", "source_size", "target", "copies")
        want = brute.mix(collected(slim.orderBy("row"), "doc_id", "source", "text"))
        rounded = lambda rows: order((r[0], r[1], r[2], round(r[3], 6), int(r[4])) for r in rows)
        assert rounded(got) == rounded(want)
        assert all(r[4] in (0, 1, 2) for r in got)
        out = mixing.mixed_rows(table)
        assert out.schema == table.schema and out.count() == sum(r[4] for r in got)


def test_targets_of_many_sources(spark):
    rng = random.Random(5)
    sizes = {None if k == 0 else f"s{k}": rng.choice([0, 1, 5, 50, 5000]) for k in range(40)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_quality_counts_and_ratio(spark, docs, sf001):
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    for table in tables(spark, docs):
        rows = collected(table, "doc_id", "text")
        found = quality.score(table.select("doc_id", "text"), quality.fit(table, labels))
        got = collected(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ratio", "base_failed", "kept")
        want = []
        for (doc_id, text), ratio in zip(rows, brute.log_ratios(rows, trusted), strict=True):
            base = brute.base_counts(text)
            failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
            want.append((doc_id, *base, round(ratio, 7), failed, not failed and ratio >= quality.THRESHOLD))
        assert order((*r[:6], round(r[6], 7) + 0.0, *r[7:]) for r in got) == order((*r[:6], r[6] + 0.0, *r[7:]) for r in want)
        out = quality.quality_filter(table, labels)
        assert out.schema == table.schema and order(collected(out, "doc_id")) == order((r[0],) for r in want if r[8])


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) is None
    found = quality.score(docs, None)
    assert found.filter("kept = base_failed").count() == 0 and found.count() == docs.count()


def test_trusted_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert quality.trusted_ids(labels.union(labels), 100).count() <= 100
