"""What executors hold and write beside the rows: files of small tables, and the numbers of a replay."""

import random
import tracemalloc
from urllib.parse import urlparse

import pytest

from wattline.llm import bpe, common, graph, minhash


@pytest.fixture
def many_partitions(spark):
    """211 shuffle partitions that Spark may not put together, as on the check tool's skewed table."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(spark, work):
    """What ``work`` returns, and the numbers of files of the tables that it wrote."""
    from pathlib import Path

    with common.scratch(spark):
        out = work()
        return out, [len(list(Path(urlparse(p).path).glob("part-*"))) for p in common._scopes.tables]


def test_rounds_of_components_write_few_files(spark, many_partitions):
    links = [(k, k + 1) for k in range(60)] + [(1000 * c, 1000 * c + k) for c in range(1, 40) for k in range(1, 30)]
    given = spark.createDataFrame(links, "a long, b long")
    for known in (None, len(links)):
        got, files = written(spark, lambda known=known: {r.node: r.root for r in graph.components(given, known).collect()})
        assert got == {k: 0 for k in range(61)} | {1000 * c + k: 1000 * c for c in range(1, 40) for k in range(30)}
        rounds = files if known else files[1:]
        assert len(rounds) > 2 and max(rounds) <= spark.sparkContext.defaultParallelism


def test_near_dedup_of_many_partitions_writes_few_files(spark, many_partitions):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(300):
        own = rng.choices(words, k=60)
        texts += [" ".join(own), " ".join([*own[:-1], "other"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got, files = written(spark, lambda: sorted(r.doc_id for r in minhash.near_dedup(docs).select("doc_id").collect()))
    assert got == list(range(0, 600, 2))
    # of its tables five at most are as wide as the shuffle: lists, entries, texts, sets and links of units
    assert sum(n > spark.sparkContext.defaultParallelism for n in files) <= 5


def test_packed_keeps_rows_and_asks_rows_for_tasks(spark):
    rows = spark.range(0, 5000, 1, 64)
    (few, many), files = written(spark, lambda: (common.packed(rows, 5000).count(), common.packed(rows, 40 * common.FILE_ROWS).count()))
    assert (few, many) == (5000, 5000)
    assert files == [spark.sparkContext.defaultParallelism, 40]


def test_replay_holds_few_bytes_a_byte_of_its_words():
    import public_tokenizers

    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).replay
    rng = random.Random(7)
    words = [bytes(rng.choices(b"etaoinshrdlu", k=rng.randint(5, 12))) for _ in range(60_000)]
    tracemalloc.start()
    ids = own.encode(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b"".join(map(own.tokens.__getitem__, i)) for i in ids[::50]] == words[::50]
    assert [own._alone(w) for w in words[::50]] == ids[::50]
    assert peak < 110 * sum(map(len, words))
