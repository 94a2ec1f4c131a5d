"""Collocations: frequent phrases by language, counted in counting quotient filters that lose nothing."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, table

LONGEST = 5
LEAST_COUNT = 100
# A phrase goes if a longer one has this many per cent of its occurrences.
INSIDE = 100
TOP = 2000
NO_LANG = "und"
# Phrases end at these; all white space but blanks and tabs is among them.
MARKS = b".,;:!?\n\x0b\x0c\r"
# Rounds of the permutation of packed phrases, and bits of its quotient.
ROUNDS, QUOTIENT_BITS = 2, 20
_LEAD = 6  # bytes that hold the other bits of a leading number
# Bytes of text that are counted at once, and phrases at which a filter is handed on.
BLOCK_BYTES, FILTER_ROWS = 1 << 21, 1 << 20
# A merge of filters takes the quotients of about this many words of the corpus, up to 2 ** QUOTIENT_BITS merges.
PART_WORDS = 1 << 21
# Bits of the map of phrases that may be frequent. It has this size for any corpus; a full one costs time, no phrase.
MAP_BITS = 26
# Words whose counts a worker gathers before it hands them on.
WORD_ROWS = 300_000
_BREAK = re.compile(b"[" + re.escape(MARKS) + b"]")
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: ends a phrase
_KIND[list(b" \t")], _KIND[list(MARKS)] = 1, 2
_BLANKS = bytes.maketrans(MARKS, b" " * len(MARKS))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _turned(rows: np.ndarray, back: bool) -> np.ndarray:
    out, n = rows.copy(), rows.shape[1]
    steps = [(r, k) for r in range(ROUNDS) for k in range(n - 1, -1, -1)] if n > 1 else []
    for r, k in reversed(steps) if back else steps:
        out[:, k] ^= _mix(out[:, (k + 1) % n] + _U(r * n + k + 1))
    return out


def permute(packed: np.ndarray) -> np.ndarray:
    """Packed phrases (a row of word numbers each) to rows that look random. Each step changes one number by a hash of another, which can be
    undone; no two phrases become one."""
    return _turned(packed, False)


def restore(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``permute``."""
    return _turned(rows, True)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of four widths, which the first byte names."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class QuotientFilter:
    """Exact counts of permuted phrases in the order of quotient and remainder.

    The quotient is the upper QUOTIENT_BITS of a row. A stored filter does not hold it, only how many rows each quotient has, and then the
    remainders, which are all other bits: equal entries are equal phrases."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.counts = rows, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def counting(cls, rows: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """The filter of rows in any order, with repeats."""
        order = np.argsort(rows[:, 0], kind="stable")
        rows = rows[order]
        equal = (rows[1:] == rows[:-1]).all(1)
        if (~equal & (rows[1:, 0] == rows[:-1, 0])).any():  # rows that differ share a leading number
            again = np.lexsort(rows.T[::-1])
            rows, order = rows[again], order[again]
            equal = (rows[1:] == rows[:-1]).all(1)
        if not len(rows):
            return cls(rows, np.zeros(0, np.int64))
        starts = np.flatnonzero(np.concatenate([[True], ~equal]))
        return cls(rows[starts], np.add.reduceat(counts[order], starts))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        return cls.counting(np.concatenate([f.rows for f in filters]), np.concatenate([f.counts for f in filters]))

    def slices(self, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(part, rows of each quotient, remainders, counts) for every range of quotients that has rows."""
        quotient = (self.rows[:, 0] >> _U(64 - QUOTIENT_BITS)).astype(np.int64)
        part = (quotient * parts) >> QUOTIENT_BITS
        for p in np.unique(part).tolist():
            own = slice(*np.searchsorted(part, [p, p + 1]))
            low, high = _range(p, parts)
            rows = self.rows[own].astype("<u8").view(np.uint8).reshape(-1, 8 * self.rows.shape[1])
            held = np.concatenate([rows[:, :_LEAD], rows[:, 8:]], axis=1)
            held[:, _LEAD - 1] &= (1 << (64 - QUOTIENT_BITS) % 8) - 1
            yield p, _packed(np.bincount(quotient[own] - low, minlength=high - low)), held.tobytes(), _packed(self.counts[own])

    @classmethod
    def of_slice(cls, part: int, parts: int, runs: bytes, remainders: bytes, counts: bytes, length: int) -> QuotientFilter:
        low, high = _range(part, parts)
        quotient = np.repeat(np.arange(low, high, dtype=np.uint64), _unpacked(runs))
        held = np.frombuffer(remainders, np.uint8).reshape(len(quotient), _LEAD + 8 * (length - 1))
        rows = np.zeros((len(quotient), 8 * length), np.uint8)
        rows[:, :_LEAD], rows[:, 8:] = held[:, :_LEAD], held[:, _LEAD:]
        rows = rows.view("<u8").astype(np.uint64)
        rows[:, 0] |= quotient << _U(64 - QUOTIENT_BITS)
        return cls(rows, _unpacked(counts))


def _range(part: int, parts: int) -> tuple[int, int]:
    """Quotients of a part: those q with q * parts >> QUOTIENT_BITS equal to it."""
    return -(-(part << QUOTIENT_BITS) // parts), -(-((part + 1) << QUOTIENT_BITS) // parts)


def _places(packed: np.ndarray) -> np.ndarray:
    """Place of every packed phrase in the map."""
    out = np.full(len(packed), packed.shape[1], np.uint64)
    for k in range(packed.shape[1]):
        out = _mix(out ^ packed[:, k])
    return (out >> _U(64 - MAP_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases to the words of the map in which they set bits."""
    held = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for batch in batches:
        if batch.num_rows:
            at = _places(batch.column(0).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1))
            np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    words = held.view("<i8")
    used = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used])], ["at", "bits"])


def _map_of(frequent: DataFrame) -> np.ndarray:
    """Map with the bits of all phrases (ids): a row per word of the map reaches the driver, 2 ** (MAP_BITS - 6) at most."""
    rows = frequent.select("ids").mapInArrow(_marked, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << (MAP_BITS - 6), "<i8")
    held[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return held.view(np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """Rows (lang, text) as lists of (lang, text in lower case) of about BLOCK_BYTES; a longer text is cut where a phrase ends."""
    held, size = [], 0
    for batch in batches:
        langs, texts = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary())
        for lang, text in zip(langs, texts, strict=True):
            data = text.as_buffer().to_pybytes().lower() if text.is_valid else b""  # bytes: A-Z only
            at = 0
            while at < len(data):
                cut = _BREAK.search(data, at + BLOCK_BYTES) if len(data) - at > BLOCK_BYTES else None
                part = data[at:cut.start()] if cut else data[at:]
                at += len(part) + 1
                held.append((lang, part))
                size += len(part) + 1
                if size >= BLOCK_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class _Words:
    """Words of a block: where they start and end in its bytes, their numbers, and which begin a phrase.

    A number is a sum over the word's bytes of a random value of the byte times a random odd one of its place, mixed with the
    language's hash; all are fixed by the seed."""

    def __init__(self, block: list[tuple[bytes, bytes]], seed: int):
        self.data = b"\n".join(text for _, text in block)
        raw = np.frombuffer(self.data, np.uint8)
        kind = _KIND[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        sizes = self.ends - self.starts
        texts = np.cumsum([0, *(len(t) + 1 for _, t in block)])
        self.text = np.searchsorted(texts, self.starts, "right") - 1
        marks = np.cumsum(kind == 2)[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.breaks = np.concatenate([[False], marks[1:] != marks[:-1]]) if len(marks) else np.zeros(0, bool)
        if not len(sizes):
            self.numbers = np.zeros(0, np.uint64)
            return
        of_byte = _mix(np.arange(256, dtype=np.uint64) + _U(1 + 1000 * seed))
        of_place = _mix(np.arange(int(sizes.max()), dtype=np.uint64) + _U(500 + 1000 * seed)) | _U(1)
        at = np.flatnonzero(kind == 0)
        sums = np.add.reduceat(of_byte[raw[at]] * of_place[at - np.repeat(self.starts, sizes)], np.cumsum(sizes) - sizes)
        langs = {lang: xxhash.xxh64_intdigest(lang, seed) for lang in {lang for lang, _ in block}}
        of_text = np.fromiter((langs[lang] for lang, _ in block), np.uint64, len(block))
        self.numbers = np.maximum(_mix(sums ^ of_text[self.text]), _U(1))

    def row(self) -> np.ndarray:
        """Numbers in order, with a 0 where phrases end."""
        out = np.zeros(len(self.numbers) + int(self.breaks.sum()), np.uint64)
        out[np.arange(len(self.numbers)) + np.cumsum(self.breaks)] = self.numbers
        return out


def _word_counter(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, word, number, f): counts of the words of a task, in parts."""
        counts: dict[bytes, Counter] = defaultdict(Counter)

        def given() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, own in counts.items() for word, n in own.items()]
            counts.clear()
            langs, words, times = ([r[k] for r in rows] for k in range(3))
            numbers = _Words(list(zip(langs, words, strict=True)), seed).numbers.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()).cast(pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers),
                                               pa.array(times, pa.int64())], ["lang", "word", "number", "f"])

        for block in _blocks(batches):
            for lang, text in block:
                counts[lang].update(text.translate(_BLANKS).split())
            if sum(map(len, counts.values())) > WORD_ROWS:
                yield given()
        yield given()

    return run


def _phrase_counter(shared, length: int, parts: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of ``length`` words whose two shorter ones are in the map, counted in filters; each is handed on in slices of quotients."""
        held: list[QuotientFilter] = []
        may_be = shared.value

        def given() -> pa.RecordBatch:
            rows = list(QuotientFilter.merged(held).slices(parts))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
                                              ["part", "runs", "remainders", "counts"])

        for block in _blocks(batches):
            row = _Words(block, seed).row()
            shorter = np.lib.stride_tricks.sliding_window_view(row, length - 1) if len(row) >= length else np.zeros((0, length - 1), np.uint64)
            good = np.flatnonzero((shorter != 0).all(1))
            at = _places(shorter[good])
            good = good[(may_be[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            starts = good[:-1][np.diff(good) == 1]
            if not len(starts):
                continue
            packed = np.lib.stride_tricks.sliding_window_view(row, length)[starts]
            held.append(QuotientFilter.counting(permute(packed), np.ones(len(starts), np.int64)))
            if sum(map(len, held)) > FILTER_ROWS:
                held[:] = [QuotientFilter.merged(held)]
                if 2 * len(held[0]) > FILTER_ROWS:
                    yield given()
        if held:
            yield given()

    return run


def _merger(length: int, parts: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merges the slices of a part, which arrive one after another, and gives its phrases of ``least`` occurrences or more."""
        part, held = None, []

        def frequent() -> Iterator[pa.RecordBatch]:
            if held:
                own = QuotientFilter.merged(held)
                held.clear()
                kept = own.counts >= least
                ids = restore(own.rows[kept]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * length), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(own.counts[kept])], ["ids", "f"])

        for batch in batches:
            for p, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    yield from frequent()
                    part = p
                held.append(QuotientFilter.of_slice(p, parts, *data, length))
                if len(held) > 1 and sum(map(len, held[1:])) > max(FILTER_ROWS, len(held[0])):
                    held[:] = [QuotientFilter.merged(held)]
        yield from frequent()

    return run


def corpus_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[DataFrame, int]:
    """Written table (lang, word, number, f) of all words of all whole texts, and the seed of their numbers: the first with which no two words of
    the table share a number. A null lang is NO_LANG; a null text has no words."""
    plain = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    seed = 0
    while True:
        counted = plain.mapInArrow(_word_counter(seed), "lang string, word string, number long, f long")
        words = reliable(counted.groupBy("lang", "word", "number").agg(F.sum("f").alias("f")))
        if words.groupBy("number").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            return words, seed
        seed += 1


def frequent_phrases(docs: DataFrame, words: DataFrame, seed: int, least: int = LEAST_COUNT, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(ids, f): all phrases of one to ``longest`` words (their numbers) of ``least`` occurrences or more, exactly counted.

    A phrase of n words is counted if the map of phrases of n - 1 words has both that it holds; the map may hold too many, never too few. Tasks count
    permuted phrases in quotient filters and hand them on in ranges of quotients, which are merged."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = max(1, min(1 << QUOTIENT_BITS, -(-total // PART_WORDS)))
    found = level = reliable(words.filter(F.col("f") >= least).select(F.array("number").alias("ids"), "f"))
    for length in range(2, longest + 1):
        if level.isEmpty():
            break
        shared = spark.sparkContext.broadcast(_map_of(level))  # 2 ** MAP_BITS bits
        slices = plain.mapInArrow(_phrase_counter(shared, length, parts, seed), "part int, runs binary, remainders binary, counts binary")
        merged = slices.repartition("part").sortWithinPartitions("part").mapInArrow(_merger(length, parts, least), "ids array<bigint>, f long")
        level = reliable(merged)
        found = found.union(level)
    return found


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, longest: int = LONGEST, inside: int = INSIDE, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the ``top`` phrases of two to ``longest`` words and ``least`` occurrences or more.

    A phrase's occurrences are a; n are all words of its language; its score is the least of floor(1000 * a * n / (l * r)) over its cuts into two parts
    of l and r occurrences (the first such cut counts). Phrases inside a longer one of at least ``inside`` per cent of
    their occurrences are left out. Order: score, a (both falling), phrase by its bytes. Texts are split at MARKS into pieces and those at
    blanks and tabs into words, A-Z in lower case. Null texts have no words, a null lang is NO_LANG, repeated rows count each time, other columns are not
    read, an empty table gives no rows."""
    words, seed = corpus_words(docs, lang, text)
    known = reliable(frequent_phrases(docs, words, seed, least, longest, lang, text))
    size = F.size("ids")
    phrases = known.filter(size > 1).withColumnRenamed("f", "a")
    # what a phrase one word longer has; still longer ones have no more
    around = known.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    phrases = phrases.join(around.groupBy("ids").agg(F.max("f").alias("most")), "ids", "left").filter(F.coalesce(100 * F.col("most") < inside * F.col("a"), F.lit(True)))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    langs = words.filter(F.col("f") >= least).select("lang", "word", "number").join(totals, "lang")
    phrases = phrases.join(langs.select(F.col("number").alias("head"), "lang", "n"), F.col("head") == F.col("ids")[0]).drop("head", "most")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("cut"))).withColumn("right", F.slice("ids", F.col("cut") + 1, size - F.col("cut")))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    whole = {c: f"cast({c} as decimal(19,0))" for c in "anlr"}
    # products of 38 digits; one that has more fails
    cuts = cuts.withColumn("score", F.expr(f"(1000 * {whole['a']} * {whole['n']}) div ({whole['l']} * {whole['r']})"))
    scored = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "ids", "a", "n", "best.l", "best.r", "best.score")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = reliable(scored.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place"))
    named = first.select("ids", F.posexplode("ids").alias("at", "number")).join(langs.select("number", "word"), "number")
    texts = named.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own")).select("ids", F.array_join("own.word", " ").alias("phrase"))
    ranked = first.join(texts, "ids").withColumn("rank", F.row_number().over(by_score.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
with pieces as (
  select coalesce(lang, '{NO_LANG}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
worded as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from worded group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as g
  from worded, (select unnest(range(1, {LONGEST + 1})) as k)),
often as (select lang, k, g, count(*)::bigint as f from grams group by all having count(*) >= {LEAST_COUNT}),
around as (
  select lang, g, max(f) as most from (
    select lang, g[1:k - 1] as g, f from often where k > 2 union all select lang, g[2:] as g, f from often where k > 2) group by all),
cuts as (
  select o.lang, o.g, o.f as a, x.f as l, y.f as r, n, (1000::hugeint * o.f * n) // (x.f::hugeint * y.f) as score, cut
  from (select *, unnest(range(1, k)) as cut from often where k > 1) o
  join totals using (lang)
  join often x on x.lang = o.lang and x.g = o.g[1:cut]
  join often y on y.lang = o.lang and y.g = o.g[cut + 1:]),
lowest as (select * from cuts qualify row_number() over (partition by lang, g order by score, cut) = 1),
kept as (
  select w.lang, array_to_string(w.g, ' ') as phrase, a, l, r, n, score::bigint as score
  from lowest w left join around s on s.lang = w.lang and s.g = w.g where most is null or 100 * most < {INSIDE} * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= {TOP}
"""
