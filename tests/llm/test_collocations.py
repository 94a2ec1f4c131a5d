"""Collocations against plain counts, and the filters that count them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wattline.llm import collocations
from wattline.llm.collocations import QuotientFilter

from .data import awkward, empty


def plain(rows, least, top=2000, longest=5):
    """(lang, text) to (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    f[lang, tuple(words[at:at + k])] += 1
    often = {g: c for g, c in f.items() if c >= least}
    out = []
    for (lang, g), a in often.items():
        k = len(g)
        if k == 1 or any(b >= a for (other, h), b in often.items() if other == lang and len(h) > k and any(h[j:j + k] == g for j in range(len(h) - k + 1))):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, g[:c]] * f[lang, g[c:]]), c) for c in range(1, k))
        out.append((lang, " ".join(g), a, f[lang, g[:cut]], f[lang, g[cut:]], n[lang], score))
    out.sort(key=lambda r: (r[0].encode(), -r[6], -r[2], r[1].encode()))
    ranks, final = Counter(), []
    for lang, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            final.append((lang, ranks[lang], *rest))
    return final


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", low)]


def plain_number(lang, word, seed=0):
    """The number of a word by whole numbers, as a signed long."""
    top = 1 << 64

    def mix(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % top
        x = (x ^ x >> 29) * 0x9E3779B97F4A7C15 % top
        return x ^ x >> 32

    total = sum(mix(b + 1 + 1000 * seed) * (mix(k + 500 + 1000 * seed) | 1) for k, b in enumerate(word.encode())) % top
    out = max(1, mix(total ^ xxhash.xxh64_intdigest(lang.encode(), seed)))
    return out - top if out >= top // 2 else out


def collected(df):
    return sorted((tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=lambda r: (r[0].encode(), r[1]))


def made_rows():
    """Few words, so that phrases repeat and scores tie; fixed phrases inside longer ones; two languages that share words."""
    rng = random.Random(8)
    words = ["a", "b", "c", "der", "Der", "ü", "漢", "x\x00y", "z\x1f"]
    rows = []
    for k in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "\x0b"]) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text + rng.choice(["", "one two three four five six", " New York City", "new york city"])))
    return rows + [("en", None), (None, None), ("en", ""), ("en", " \t\n.")]


@pytest.mark.parametrize("least, top", [(3, 2000), (20, 5), (10 ** 9, 10)])
def test_equals_plain_counts(spark, least, top):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = plain(rows, least, top)
    assert collected(collocations.collocations(docs, least, top)) == want and (want or least > 1000)


def test_small_blocks_filters_and_parts(monkeypatch):
    """Many filters, slices and merges give the same counts. The functions of the tasks run here, with small settings."""
    rows = made_rows()
    texts = [(a if a is not None else "und", b) for a, b in rows]
    for name, value in (("BLOCK_BYTES", 200), ("FILTER_ROWS", 100), ("WORD_ROWS", 3)):
        monkeypatch.setattr(collocations, name, value)
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts], pa.string())], ["lang", "text"])

    class Shared:
        value = np.full(1 << (collocations.MAP_BITS - 3), 255, np.uint8)

    slices = [s for half in (batch.slice(0, 150), batch.slice(150)) for s in collocations._phrase_counter(Shared, 3, 7, 0)(iter([half]))]
    table = pa.Table.from_batches(slices).sort_by("part")
    got = Counter()
    for out in collocations._merger(3, 7, 1)(iter(table.to_batches(max_chunksize=3))):
        for ids, f in zip(out["ids"].to_pylist(), out["f"].to_pylist(), strict=True):
            assert tuple(ids) not in got
            got[tuple(ids)] = f
    want = Counter()
    for lang, text in texts:
        for piece in pieces(text):
            row = [plain_number(lang, w) for w in piece]
            want.update(tuple(row[k:k + 3]) for k in range(len(row) - 2))
    assert len(slices) > 5 and got == want
    words = Counter()
    for out in collocations._word_counter(0)(iter([batch])):
        for lang, word, number, f in zip(*(c.to_pylist() for c in out.columns), strict=True):
            assert number == plain_number(lang, word)
            words[lang, word] += f
    assert words == Counter((lang, w) for lang, text in texts for piece in pieces(text) for w in piece)


def test_long_texts_are_cut_where_phrases_end(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    text = " ".join(f"w{k % 7}" + (". " if k % 11 == 0 else "") for k in range(400)) + "," + "x" * 300 + " y " * 100
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    blocks = list(collocations._blocks(iter([batch])))
    assert len(blocks) > 10
    got = [p for block in blocks for _, part in block for p in pieces(part.decode()) if p]
    assert got == [p for p in pieces(text) if p]


def test_two_words_of_one_number_are_seen(spark, monkeypatch):
    """With a hash of few values words collide; each keeps a row of its own, so that the next seed is tried."""
    real = collocations._mix
    monkeypatch.setattr(collocations, "_mix", lambda x: real(x) & np.uint64(3))
    words = ["a", "b", "c", "d", "e", "ff", "gg", "h" * 9, "a", "a", "gg"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([" ".join(words), "a b"])], ["lang", "text"])
    (out,) = collocations._word_counter(0)(iter([batch]))
    got = Counter()
    for lang, word, _, f in zip(*(c.to_pylist() for c in out.columns), strict=True):
        got[lang, word] += f
    assert got == Counter([("en", w) for w in words] + [("de", "a"), ("de", "b")])


def test_words_have_numbers_of_their_own(spark):
    assert plain_number("en", "a") != plain_number("en", "a", 1) and plain_number("en", "a") != plain_number("de", "a")
    words, seed = collocations.corpus_words(spark.createDataFrame([("en", "a b a"), ("de", "a")], "lang string, text string"))
    assert seed == 0 and sorted((r.lang, r.word, r.f) for r in words.collect()) == [("de", "a", 1), ("en", "a", 2), ("en", "b", 1)]


@pytest.mark.parametrize("length", [1, 2, 3, 5])
def test_permutation_is_undone(length):
    rng = np.random.default_rng(length)
    rows = np.concatenate([rng.integers(0, 1 << 64, (2000, length), dtype=np.uint64), np.zeros((1, length), np.uint64), np.full((1, length), (1 << 64) - 1, np.uint64)])
    assert (collocations.restore(collocations.permute(rows)) == rows).all()


@pytest.mark.parametrize("parts", [1, 3, 64, 1000, 1 << 20])
def test_filters_keep_every_count(parts):
    rng = np.random.default_rng(parts)
    rows = rng.integers(0, 1 << 64, (500, 3), dtype=np.uint64)[rng.integers(0, 500, 3000)]
    rows[:300, 0] = rows[0, 0]  # one leading number, different phrases
    counts = rng.integers(1, 1 << 40, 3000)
    want = Counter()
    for r, c in zip(map(tuple, rows.tolist()), counts.tolist(), strict=True):
        want[r] += c
    halves = [QuotientFilter.counting(rows[k::2], counts[k::2]) for k in (0, 1)]
    back = [QuotientFilter.of_slice(*s[:1], parts, *s[1:], 3) for h in halves for s in h.slices(parts)]
    merged = QuotientFilter.merged(back)
    assert dict(zip(map(tuple, merged.rows.tolist()), merged.counts.tolist(), strict=True)) == want
    assert (np.diff(merged.rows[:, 0].astype(object)) >= 0).all()
    empty_one = QuotientFilter.counting(rows[:0], counts[:0])
    assert len(empty_one) == 0 and list(empty_one.slices(parts)) == []


@pytest.mark.parametrize("rows", [awkward, empty])
def test_awkward_rows(spark, rows):
    docs = rows(spark)
    given = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    short = [(lang, text) for lang, text in given if len(text or "") < 10_000]
    assert collected(collocations.collocations(docs.filter("coalesce(length(text), 0) < 10000"), 2)) == plain(short, 2)
    assert collected(collocations.collocations(docs, 2, longest=3)) == plain(given, 2, longest=3)
