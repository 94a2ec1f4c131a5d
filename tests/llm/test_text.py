"""Token files, BPE, language identification, archives and chat pairs."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattline.llm import bpe, chat, language_id, token_files, warc
from wattline.llm.common import file_system, new_folder

from . import brute
from .data import TEXTS, awkward, empty, order

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "aabbcc  \n\t\r\x0b\x85  é漢字🙂123½²'st'LL.,-_ ́<|endoftext|>ABC"


@pytest.fixture(scope="module")
def docs(spark, sf001):
    return spark.read.parquet(f"{sf001}/documents.parquet")


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(2)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [t for t in TEXTS if t] + [" ", "  ", "a ", "a  b", "\n a", "a" * 40]


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# token files

@pytest.mark.parametrize("top", [1, 2, 50_257, 1 << 20, 1 << 32])
@pytest.mark.parametrize("percentile", [50, 90, 98, 100])
def test_blocks_round_trip(top, percentile):
    rng = np.random.default_rng(top)
    values = rng.integers(0, top, (7, 333), dtype=np.uint64).astype(np.uint32)
    values[2] = values[2, 0]
    values[3, ::50] = top - 1
    blocks = token_files.encode_blocks(values, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_files.decode_blocks(b"".join(blocks), starts) == values.reshape(-1)).all()


def test_tokenizer_is_the_library(odd_texts, docs):
    own, library = token_files.tokenizer(JSON), Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    texts = odd_texts + [r.text for r in docs.collect()]
    for text, ids in zip(texts, own.pieces.run(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files(spark, docs):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    for table in (docs, awkward(spark), empty(spark)):
        manifest = token_files.write_tokens(table, new_folder(spark, "tokens"), JSON, block=100, file_tokens=20_000)
        got = sorted(collected(token_files.read_tokens(manifest), "doc_id", "start", "n_tokens", "ids_crc32", "ids"), key=lambda r: r[1])
        want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in table.select("doc_id", "text").collect()]
        assert order((r[0], tuple(r[4])) for r in got) == order((d, tuple(i)) for d, i in want)
        assert [brute.key(r[0]) for r in got] == sorted(brute.key(d) for d, _ in want)
        place = 0
        for _, start, n, crc, ids in got:
            assert (start, n, crc) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            place += n


def test_token_file_random_access(spark, docs):
    first = token_files.write_tokens(docs, new_folder(spark, "tokens"), JSON, block=64).first()
    reader = token_files.TokenFileReader(first.path)
    whole = np.concatenate([ids for _, _, ids in reader.documents(group=500)])
    for a, b in ((0, 1), (63, 65), (100, 900), (len(whole) - 3, len(whole)), (5, 5)):
        assert (reader.tokens(a, b) == whole[a:b]).all()
    store, path = file_system(first.path)
    assert store.get_file_info(path).size == first.bytes


# BPE

def test_bpe_is_tiktoken(odd_texts, docs):
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.replay.ranks, special_tokens={})
    texts = odd_texts + [r.text for r in docs.collect()]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_texts_without_new_words():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for texts in ([], [""], ["", ""], ["a b"], ["a b", ""], ["b a"]):
        assert [own.decode(i) for i in own.encode(texts)] == [t.encode() for t in texts]


def test_ranks_out_of_order():
    """Merges that make pairs of lower rank, and tokens that several pairs make."""
    rng = random.Random(4)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        order_of = rng.sample(sorted(tokens), len(tokens))
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(order_of)}
        library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(40)]
        assert bpe.MergeReplay(ranks).encode(words) == [library.encode_ordinary(w.decode()) if w not in ranks else [ranks[w]] for w in words] or all(
            bpe.MergeReplay(ranks).encode([w])[0] == library.encode_ordinary(w.decode()) for w in words if w not in ranks)


def test_encode_rows(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (docs, awkward(spark), empty(spark)):
        got = collected(bpe.encode(table, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids)))
        assert order((*r[:4], tuple(r[4])) for r in got) == order(want)


# language

def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 512, 5000):
        text = bytes(k % 251 + 1 for k in range(n))
        rows = language_id.windows(text)
        for k in range(n - 3):
            assert any(text[k:k + 4] in r.tobytes() for r in rows[max(0, k // 253 - 1):k // 253 + 2])


def test_languages(spark, sf01):
    got = language_id.op5(spark, sf01).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    changed = docs.withColumn("lang", F.when(language_id.fold() == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = language_id.fit(docs), language_id.fit(changed)
    assert a.languages == b.languages and all((a.filters[w] == b.filters[w]).all() for w in a.filters)


def plain_network(network, text):
    """Mean probabilities of a text, filter by filter and place by place."""
    data = text.encode()
    step = language_id.WINDOW - (max(language_id.WIDTHS) - 1)
    total, n = 0, 0
    for start in range(0, max(1, len(data) - (max(language_id.WIDTHS) - 1)), step):
        window = data[start:start + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
        pooled = []
        for w in language_id.WIDTHS:
            for f in range(network.filters[w].shape[2]):
                pooled.append(max(sum(float(network.filters[w][j, window[at + j], f]) for j in range(w)) for at in range(language_id.WINDOW - w + 1)))
        hidden = [max(0.0, v + float(b)) for v, b in zip(pooled, network.bias, strict=True)]
        score = [sum(h * float(network.weights[k, c]) for k, h in enumerate(hidden)) + float(network.offset[c]) for c in range(len(network.languages))]
        odds = [np.exp(v - max(score)) for v in score]
        total, n = total + np.array(odds) / sum(odds), n + 1
    return total / n


def test_network_equals_the_plain_version(docs):
    network = language_id.fit(docs, steps=30)
    texts = ["Ein kurzer Text.", "the of and " * 40, "é", None, "1234", "", "Über " * 90]
    got = network.predict(texts)
    assert [g for g, t in zip(got, texts, strict=True) if t in (None, "1234", "")] == [("und", 0.0)] * 3
    for (lang, score), text in zip(got, texts, strict=True):
        if lang != "und":
            mean = plain_network(network, text)
            assert lang == network.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-4
    assert [g for t in texts for g in network.predict([t])] == got


def test_sample_is_bounded(spark, docs):
    """A document that is repeated 5,000 times is drawn within the bound, and the order of rows changes nothing."""
    one = docs.filter("lang is not null").filter(language_id.fold() != 2).limit(1)
    many = docs.union(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("copy"))
    a, b = language_id.fit(many, per_language=20, steps=5), language_id.fit(many.repartition(7), per_language=20, steps=5)
    assert all((a.filters[w] == b.filters[w]).all() for w in a.filters)


def test_awkward_languages(spark, docs):
    network = language_id.fit(docs)
    for table in (awkward(spark), empty(spark)):
        got = collected(language_id.predict(table, network), "doc_id", "lang_pred", "score")
        letters = [any(c.isalpha() for c in r.text or "") for r in table.select("text").collect()]
        assert len(got) == len(letters) and sum(r[1] == "und" for r in got) == letters.count(False)
    assert language_id.fit(empty(spark)) is None
    assert {r[1] for r in collected(language_id.predict(awkward(spark), None), "doc_id", "lang_pred")} == {"und"}


# archives

def test_archives(spark):
    big = "<p>" + "é" * 60 + "</p>"
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (3, "http://a/2", big), (None, "u\r\nX-Evil: 1", big), (9, None, "short"), (8, "http://b", "short"), (7, "http://c", None), (6, "http://d", ""), (4, "http://e", "x\r\n\r\ny" * 40)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, row int, digest string").repartition(4)
    folder = new_folder(spark, "warc")
    manifest = warc.write_archives(pages, folder, file_bytes=600)
    got = collected(warc.read_archives(manifest), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    large = [r for r in got if r[1] == len(big.encode())]
    assert sorted((r[3], r[4]) for r in large if r[3] == "response") == [("response", None)] and [r[0] for r in large if r[3] == "response"] == [3]
    assert sum(r[3] == "revisit" and r[4] == 3 for r in large) == 3
    want = order((r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows)
    assert order(r[:3] for r in got) == want
    assert all(bytes(r[5]) == next((x[2] or "").encode() for x in rows if x[0] == r[0]) for r in got if r[3] == "response")
    store, path = file_system(manifest.first().path)
    assert gzip.decompress(store.open_input_stream(path).read()).startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(warc.write_archives(pages.limit(0), new_folder(spark, "warc"))).count() == 0


# chat

def plain_pair(c, r):
    n = next((k for k, (a, b) in enumerate(zip(c, r)) if a != b), min(len(c), len(r)))
    piece = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"
    prompt = "".join(map(piece, c[:n]))

    def side(turns):
        text, spans = "", []
        for t in turns[n:]:
            start = len(prompt) + len(text) + len(f"<|{t[0]}|>\n")
            text += piece(t)
            if t[0] == "assistant":
                spans.append((start, len(prompt) + len(text) - 1 + 1))
        return text, spans

    return n, prompt, *side(c), *side(r)


def test_pairs(spark):
    turns = {
        1: ([("user", "q"), ("assistant", "good"), ("user", "x")], [("user", "q"), ("assistant", "bad")]),
        2: ([("system", "s"), ("user", "q"), ("assistant", "a🙂")], [("system", "s"), ("user", "q"), ("assistant", "a🙂")]),
        3: ([("user", "")], [("user", ""), ("assistant", "y")]),
        4: ([("user", "p")], [("assistant", "p")]),
    }
    frame = lambda side: spark.createDataFrame(
        [(c, k, *t, 0) for c, v in turns.items() for k, t in reversed(list(enumerate(v[side])))], "conv_id long, turn int, role string, text string, prompt int").repartition(3)
    got = {r.conv_id: r for r in chat.preference_pairs(chat.conversations(frame(0)), chat.conversations(frame(1))).collect()}
    for c, (a, b) in turns.items():
        n, prompt, x, xs, y, ys = plain_pair(a, b)
        r = got[c]
        assert (r.prefix_turns, r.prompt, r.chosen, r.rejected) == (n, prompt, x, y)
        assert [tuple(s) for s in r.chosen_spans] == xs and [tuple(s) for s in r.rejected_spans] == ys
    assert {c: r.status for c, r in got.items()} == {1: "pair", 2: "same", 3: "pair", 4: "pair"}


def test_awkward_conversations(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, None, None), (None, 0, "user", "n"), (2, 0, "assistant", "z")]
    convs = chat.conversations(spark.createDataFrame(rows, schema))
    assert {r.conv_id: [t.role for t in r.turns] for r in convs.collect()} == {1: ["user", "", ""], None: ["user"], 2: ["assistant"]}
    none = chat.conversations(spark.createDataFrame([], schema))
    assert {r.conv_id: r.status for r in chat.preference_pairs(convs, none).collect()} == {1: "chosen_only", 2: "chosen_only", None: "chosen_only"}
    assert {r.status for r in chat.preference_pairs(none, convs).collect()} == {"rejected_only"}
    assert chat.preference_pairs(none, none).count() == 0
    assert {r.conv_id for r in chat.preference_pairs(convs, chat.swapped_answers(convs)).collect()} == {1, 2, None}
    # turns without a conversation stay apart; a very long conversation and a very long text
    alone = chat.conversations(spark.createDataFrame([(None, k % 3, "user", "n" * k) for k in range(50)], schema))
    assert sorted(len(r.turns) for r in alone.collect()) == [1] * 50
    long = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", "w" * (200_000 if k == 5 else k % 7)) for k in range(3000)], schema)
    other = long.filter("turn <> 2999")
    (r,) = chat.preference_pairs(chat.conversations(long), chat.conversations(other)).collect()
    assert r.prefix_turns == 2999 and r.status == "pair" and r.rejected == "" and len(r.chosen_spans) == 1
    (r,) = chat.preference_pairs(chat.conversations(long), chat.conversations(long.filter("turn > 0"))).collect()
    text = r.prompt + r.chosen
    assert r.prefix_turns == 0 and len(r.chosen_spans) == 1500 and all(text[a:b].endswith("<|end|>\n") and text[:a].endswith("<|assistant|>\n") for a, b in r.chosen_spans)
