"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wattline.llm import spelling

from .data import CLASH, awkward, empty


def edits(a, b):
    """Whether two words are exactly one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(n):
    near = {w: [] for w in n}
    cut = {}
    for w in n:
        for x in {w} | {w[:k] + w[k + 1:] for k in range(len(w))}:
            cut.setdefault(x, set()).add(w)
    for group in cut.values():
        for a in group:
            near[a] += [b for b in group if edits(a, b) and b not in near[a]]
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda o: (-n[o], o))] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def collected(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def made():
    """Words of few letters, so that many are near, some in long chains; frequent and rare ones."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(1500)}
    words |= {"a" * k for k in range(6, 40)} | {"漢字" * k for k in range(3, 6)} | {"x" * 5000, "x" * 5001, "x" * 4999 + "y", "🙂" * 6, "🙂" * 5 + "z"}
    return {w: rng.choice([5, 6, 30, 200, 1000, 10 ** 12]) for w in words}


@pytest.mark.parametrize("frequent, tile_rows", [(500, 4096), (3, 4096), (50, 20), (10 ** 9, 4096)])
def test_variants_equal_all_pairs(spark, made, frequent, tile_rows):
    words = spark.createDataFrame(list(made.items()), "word string, n long").repartition(3)
    assert collected(spelling.variants(words, frequent=frequent, tile_rows=tile_rows)) == plain_variants(made)


def test_bound_holds_for_every_edit():
    """Two words at one edit share all grams of each but the affected ones."""
    rng = random.Random(2)
    for _ in range(300):
        text = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 12))) for _ in range(20)]
        count = Counter(w[k:k + q] for w in text for q in (2, 3) for k in range(len(w) - q + 1))
        often = {g for g, c in count.items() if c > 6}
        often = {g for g in often if len(g) == 2 or g[:2] in often}
        for w in text:
            k = rng.randrange(len(w) + 1)
            other = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcd") + w[k + 1:], w[:k] + rng.choice("abcd") + w[k:]])
            if len(other) < 6 or other == w:
                continue
            a, b = sorted([spelling.decompose(w, often), spelling.decompose(other, often)], key=len)
            shared = int(spelling.shared_grams(np.array([a]), np.array([b]))[0])
            for x in (w, other):
                own = spelling.decompose(x, often)
                assert spelling.most_affected(x, often) <= spelling.LONGEST < len(own)
                assert sum((Counter(own) & Counter(b if own == a else a)).values()) >= shared >= len(own) - spelling.most_affected(x, often) >= 1


def test_corpus_words(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    for table in (docs, awkward(spark), empty(spark)):
        want = plain_words([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
        got = {r.word: r.n for r in spelling.corpus_words(table, planted=True).collect()}
        assert got == want and (table is not docs or len(want) > 100)


def test_awkward_rows(spark):
    """Null, short, empty and repeated words, extra columns with clashing names, and an empty table."""
    given = [("thanks", 50), ("thanks", 1), ("thannks", 5), ("thansk", 5), (None, 9), ("", 9), ("short", 9), ("Thanks", 5), ("thankß", 10)]
    names = CLASH.split(", ")
    rows = [r + (1, None, "d", 1, None, 2, 3, 4, "no", 5, 6) for r in given]
    words = spark.createDataFrame(rows, "word string, n long, " + ", ".join(names))
    assert collected(spelling.variants(words)) == plain_variants({"thanks": 51, "thannks": 5, "thansk": 5, "Thanks": 5, "thankß": 10})
    assert collected(spelling.variants(words.limit(0))) == []
