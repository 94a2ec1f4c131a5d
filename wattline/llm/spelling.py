"""Spelling variants: words that one edit takes to a much more frequent word, found by variable-length grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable, table

# Lengths of grams. One edit touches LONGEST grams at most, and a word of LEAST_LENGTH letters has LEAST_LENGTH - SHORTEST + 1 of them, so
# two words at one edit share a gram.
SHORTEST, LONGEST = 2, 4
LEAST_LENGTH = 6
# A gram that occurs more often than this in the distinct words gives way to longer ones.
FREQUENT = 500
# A task compares two tiles of a list at a time; a tile has about this many words.
TILE_ROWS = 4096
# Pairs that are compared at once.
_BLOCK = 1 << 17
RATIO = 5
LEAST_COUNT = 5
RUN = "[A-Za-zÀ-ÿ]+"


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, doc_id: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """(word, n): runs of letters of all whole texts, A-Z in lower case, of enough code points and occurrences. A null text has none.

    ``planted`` drops a letter from one in 199 pairs of document and word, so that variants are known to be there; a null identifier
    counts as an empty one."""
    runs = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length)
    word = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("id", word.alias("word"))
    if planted:
        hashed = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        dropped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", hashed).select(F.when(F.col("h") % 199 == 0, dropped).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, frequent: int = FREQUENT) -> set[str]:
    """The grams of SHORTEST to LONGEST - 1 letters that the dictionary prunes for longer ones: they and their shorter beginnings occur more
    than ``frequent`` times in the distinct words.

    The dictionary is all grams of SHORTEST letters and all longer ones whose proper beginnings are here. With an alphabet of 90 letters these are at most
    737,100 grams; with any, at most a grams-per-letter share of all letters of the words."""
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - SHORTEST + 1)).alias("at"))
    sizes = F.explode(F.array(*[F.lit(q) for q in range(SHORTEST, LONGEST)]))
    grams = starts.select("word", "at", sizes.alias("q")).filter("at + q - 1 <= length(word)").select(F.expr("substring(word, at, q)").alias("gram"))
    found = {r[0] for r in grams.groupBy("gram").count().filter(F.col("count") > frequent).select("gram").toLocalIterator()}
    return {g for g in found if all(g[:q] in found for q in range(SHORTEST, len(g)))}


def wanted(word: str, frequent: set[str]) -> list[int]:
    """For every place where a gram starts, the length that the dictionary asks for; the word's end may cut it."""
    out = []
    for at in range(len(word) - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and word[at:at + q] in frequent and at + q <= len(word):
            q += 1
        out.append(q)
    return out


def decompose(word: str, frequent: set[str]) -> list[str]:
    """The longest dictionary gram at every place."""
    return [word[at:at + q] for at, q in enumerate(wanted(word, frequent))]


def most_affected(word: str, frequent: set[str]) -> int:
    """Grams that one edit can change at most.

    A gram changes if its letters do: by replacing or deleting one of them, or by inserting between them or where the word's end cut it. A gram
    that ended earlier is no beginning of a longer one of the dictionary, so nothing after it matters, and grams after the edit
    only move."""
    n, reach = len(word), [(at, at + q) for at, q in enumerate(wanted(word, frequent))]
    replaced = max(sum(at <= k < end for at, end in reach[max(0, k - LONGEST + 1):k + 1]) for k in range(n))
    inserted = max(sum(at < k < end for at, end in reach[max(0, k - LONGEST + 1):k + 1]) for k in range(n + 1))
    return max(replaced, inserted)


def _decomposer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their grams by place and the number of grams that one edit can change."""
        for batch in batches:
            words = batch.column(0).to_pylist()
            grams = pa.array([decompose(w, shared.value) for w in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams, pa.array([most_affected(w, shared.value) for w in words], pa.int32())], ["word", "grams", "affected"])

    return run


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points are one replaced letter apart or, where b is a letter longer, one inserted letter."""
    n = a.shape[1]
    head = np.cumprod(a == b[:, :n], axis=1).sum(1)
    tail = np.cumprod((a == b[:, b.shape[1] - n:])[:, ::-1], axis=1).sum(1)
    return (head + tail == n - 1) if b.shape[1] == n else (head + tail >= n)


def shared_grams(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Grams of a that b has at the same place or, where b is a letter longer, at the next one."""
    n = a.shape[1]
    same = a == b[:, :n]
    return (same if b.shape[1] == n else same | (a == b[:, 1:])).sum(1)


def _near_pairs(words: list[str], place: np.ndarray, affected: np.ndarray, grams: list[list[str]], side: np.ndarray, first: int, second: int, length: int) -> Iterator[tuple[str, str]]:
    """Pairs of a unit of a gram's list: words of ``length`` letters against each other and against those a letter longer."""
    number = {g: k for k, g in enumerate({g for own in grams for g in own})}
    size = np.array([len(w) for w in words])

    def rows(at):
        codes = np.array([np.frombuffer(words[k].encode("utf-32-le"), np.uint32) for k in at.tolist()])
        return codes, np.array([[number[g] for g in grams[k]] for k in at.tolist()], np.int32)

    order = np.argsort(place, kind="stable")
    short, long = order[size[order] == length], order[size[order] == length + 1]
    if not len(short):
        return
    mine = rows(short)
    for theirs_at in (short, long):
        if not len(theirs_at):
            continue
        theirs = mine if theirs_at is short else rows(theirs_at)
        # an edit moves a gram by a place at most
        low = np.searchsorted(place[theirs_at], place[short] - 1, "left")
        high = np.searchsorted(place[theirs_at], place[short] + 1, "right")
        if theirs_at is short:
            low = np.maximum(low, np.arange(len(short)) + 1)
        counts = np.maximum(high - low, 0)
        ends = np.cumsum(counts)
        start = 0
        while start < len(short):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BLOCK, "right")))
            n = counts[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)
            start = stop
            if first != second:
                apart = side[short[i]] != side[theirs_at[j]]
                i, j = i[apart], j[apart]
            x, y = short[i], theirs_at[j]
            count = np.array([mine[1].shape[1], theirs[1].shape[1]])
            enough = shared_grams(mine[1][i], theirs[1][j]) >= np.maximum(count[0] - affected[x], count[1] - affected[y])
            i, j, x, y = i[enough], j[enough], x[enough], y[enough]
            near = one_edit(mine[0][i], theirs[0][j])
            yield from (tuple(sorted((words[p], words[q]))) for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True))


_UNIT = ["gram", "length", "first", "second"]


def _merger(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (unit, word, place, affected, side) in the order of units, of which one is held at a time; near pairs."""
        unit, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                words, place, affected, side = zip(*held, strict=True)
                grams = [decompose(w, shared.value) for w in words]
                out.extend(_near_pairs(list(words), np.array(place), np.array(affected), grams, np.array(side), unit[2], unit[3], unit[1]))
            held.clear()

        def given() -> pa.RecordBatch:
            a, b = (pa.array([p[k] for p in out], pa.string()) for k in (0, 1))
            out.clear()
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at, *row in zip(zip(*columns[:4], strict=True), *columns[4:], strict=True):
                if at != unit:
                    close()
                    unit = at
                held.append(row)
            if len(out) >= 1 << 14:
                yield given()
        close()
        if out:
            yield given()

    return run


def near_words(words: DataFrame, frequent: int = FREQUENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): all pairs of distinct ``words`` (word), of LEAST_LENGTH letters or more, that differ by exactly one edit; each pair once.

    A gram dictionary is pruned by frequency: a gram in more than ``frequent`` places gives way to longer ones. A word has one gram per
    place. At one edit, two words share all grams of each but the affected ones, so each is listed under its rarest grams only, one more than an edit can
    affect. Lists are split by length; words in one are compared where the gram's places differ by one at most, their shared grams are
    counted against both bounds, and what is left is verified. Lists over ``tile_rows`` words are compared tile by tile; no pair is lost."""
    spark = words.sparkSession
    words = reliable(words.select("word"))
    # bounded by the alphabet, see frequent_grams
    shared = spark.sparkContext.broadcast(frequent_grams(words, frequent))
    parts = reliable(words.mapInArrow(_decomposer(shared), "word string, grams array<string>, affected int"))
    places = parts.select("word", "affected", F.posexplode("grams").alias("place", "gram"))
    times = places.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    ranked = places.join(times, "gram").groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("times", "gram", "place"))).alias("own"), F.first("affected").alias("affected"))
    prefix = ranked.select("word", "affected", F.explode(F.slice("own", F.lit(1), F.col("affected") + 1)).alias("e"))
    listed = reliable(prefix.select("word", "affected", "e.gram", "e.place", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("length")))
    lists = listed.groupBy("gram", "length").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    lists = lists.select("gram", "length", F.ceil(F.col("rows") / tile_rows).cast("int").alias("tiles"))
    tiled = listed.join(lists, ["gram", "length"]).withColumn("side", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    met = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    units = met.select("gram", "length", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"), "word", "place", "affected", "side")
    return units.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_merger(shared), "a string, b string").distinct()


def variants(words: DataFrame, ratio: int = RATIO, frequent: int = FREQUENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n).

    A word's form is its near word (one edit away) of largest n, the smallest in code-point order among equal ones, if that n is ``ratio``
    times the word's or more; else null. ``root`` follows forms to their end. Counts of rows that repeat a word are summed; null words and those of
    fewer than LEAST_LENGTH letters are left out; other columns are not read. An empty table gives no rows."""
    words = reliable(words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")))
    pairs = reliable(near_words(words, frequent, tile_rows))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = reliable(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                  F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    # n grows with every step, so paths are short; each round doubles their length
    step = reliable(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if step.join(ahead, "root", "left_semi").isEmpty():
            break
        step = reliable(step.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")))
    return found.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(corpus_words(table(spark, sf_dir, "documents"), planted=True))


OP11_SQL = f"""
with crc_table as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end))) as t),
runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents) where length(r) >= {LEAST_LENGTH}),
each as (select doc_id, run, count(*) as times from runs group by all),
bytes as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from each),
hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::bigint as crc
  from bytes, crc_table),
words as (
  select word, sum(times)::bigint as n from (
    select times, case when crc % 199 = 0 then substr(run, 1, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(times) >= {LEAST_COUNT}),
-- words at one edit: equal after one of them, or both at the same place, lose a letter
cut as (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
pairs as (
  select a.word, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cut c join words w on c.rest = w.word),
best as (select word, count(*) as n_near, max(near_n) as top, arg_min(near, (-near_n, near)) as near from pairs group by word),
found as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when top >= {RATIO} * n then near end as form, case when top >= {RATIO} * n then top end::bigint as form_n
  from words left join best using (word)),
path as (
  with recursive p as (select word, form, word as root from found union all
    select p.word, f.form, f.word from p join found f on f.word = p.form)
  select word, root from p where form is null)
select word, form, root, n, n_near, form_n from found join path using (word)
"""
