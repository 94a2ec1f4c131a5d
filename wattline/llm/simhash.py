"""Near duplicates by SimHash: byte-position index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, numbered, packed, reliable, table
from .graph import components

SHINGLE = 4
SEED = 42
# Fingerprints link at this many differing bits or fewer; each differing bit spoils one byte at most.
MOST_BITS = 4
BYTES = 8
LEAST_MATCHES = BYTES - MOST_BITS
# Entries of a posting list that one task holds; longer lists are split by four more half-bytes.
LIST_ROWS = 4096
_SETS = list(combinations(range(BYTES), LEAST_MATCHES))
_FOUND = "hot boolean, key long, a long, b long"


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text; 0 for a text without words."""
    found = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [digest(b" ".join(found), seed)]
    else:
        hashes = [digest(b" ".join(s), seed) for s in zip(*(found[k:] for k in range(words)), strict=False)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # a very long text in blocks
        part = np.array(hashes[k:k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        out = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.binary())], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): SimHash of every whole text as a signed long; null counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string")).mapInArrow(_fingerprints, "id long, fp long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fingerprint under every set of four byte positions, with the bytes there."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        parts = fp.astype("<i8").view(np.uint8).reshape(-1, BYTES).astype(np.int64)
        for number, places in enumerate(_SETS):
            key = np.full(len(fp), number, np.int64)
            for p in places:
                key = (key << 8) | parts[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def _split_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of long lists under every set of four of the eight half-bytes outside their key. At most four of them differ
    in a link, so four agree; a list then has at most 65,536 entries, as 16 bits are left."""
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        number = key >> 32
        halves = np.stack([(fp >> (4 * k)) & 15 for k in range(16)], 1)
        rest = np.array([[k for p in range(BYTES) if p not in s for k in (2 * p, 2 * p + 1)] for s in _SETS])[number]
        left = np.take_along_axis(halves, rest, 1)
        for sub, places in enumerate(_SETS):
            low = np.full(len(fp), sub, np.int64)
            for p in places:
                low = (low << 4) | left[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(low), pa.array(fp)], ["key", "low", "fp"])


# For a mask of agreeing bytes, the set of its first four; a pair counts in that set's list only.
_FIRST_SET = np.array([_SETS.index(tuple(s)) if len(s := [p for p in range(BYTES) if m >> p & 1][:LEAST_MATCHES]) == LEAST_MATCHES else -1
                       for m in range(1 << BYTES)])


def _linked(a: np.ndarray, b: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which pairs pass the tally of agreeing bytes, in the list that counts them, and the comparison of bits."""
    x = a ^ b
    agree = np.packbits(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, BYTES) == 0, axis=1, bitorder="little")[:, 0]
    return (_FIRST_SET[agree] == number) & (np.bitwise_count(x.view(np.uint64)) <= MOST_BITS)


def _forest(fp: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the verified pairs of a list connect: one per entry at most."""
    left, ends = fp, ([], [])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _linked(left, np.full(len(left), x), np.full(len(left), number))
            if hit.any():
                near = left[hit]
                ends[0].append(np.full(len(near), x))
                ends[1].append(near)
                queue.extend(near)
                left = left[~hit]
    return tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)


def _tally(limit: int | None):
    """Walks the sorted posting lists. Short ones give their links, longer than ``limit`` ones are passed on whole."""

    def found(hot: bool, key, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, hot)), pa.array(key), pa.array(a), pa.array(b)], ["hot", "key", "a", "b"])

    def lists(keys: np.ndarray, fp: np.ndarray):
        """``keys``: columns that hold a list together; the first has the set in its upper bits."""
        new = np.ones(len(fp), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
        at, group = np.flatnonzero(small), np.repeat(np.arange(len(starts)), sizes)
        for step in range(1, 8):
            i, j = at[:-step], at[step:]
            same = group[i] == group[j]
            i, j = i[same], j[same]
            if not len(i):
                break
            hit = _linked(fp[i], fp[j], keys[i, 0] >> 32)
            yield found(False, keys[i[hit], 0], fp[i[hit]], fp[j[hit]])
        for s in np.flatnonzero(sizes > 8):
            own = slice(starts[s], starts[s] + sizes[s])
            if limit and sizes[s] > limit:
                yield found(True, keys[own, 0], fp[own], fp[own])
            else:
                a, b = _forest(fp[own], int(keys[starts[s], 0] >> 32))
                yield found(False, np.full(len(a), keys[starts[s], 0]), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp, passing = None, None, None
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns - 1)], 1)
            v = batch.column(batch.num_columns - 1).to_numpy()
            if passing is not None:  # the rest of a long list streams through
                own = (k == passing).all(1)
                yield found(True, k[own, 0], v[own], v[own])
                k, v = k[~own], v[~own]
                if not len(v):
                    continue
                passing = None
            if keys is not None:
                k, v = np.concatenate([keys, k]), np.concatenate([fp, v])
            if not len(v):
                continue
            last = (k != k[-1]).any(1)
            start = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if start:
                yield from lists(k[:start], v[:start])
            keys, fp = k[start:], v[start:]
            if limit and len(fp) > limit:
                yield found(True, keys[:, 0], fp, fp)
                keys, fp, passing = None, None, keys[0]
        if keys is not None and len(fp):
            yield from lists(keys, fp)

    return run


def links(distinct: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b): links that connect all of the distinct fingerprints (fp) at MOST_BITS bits or fewer.

    Of eight bytes, a link shares four at least. The inverted index therefore has a list for every four positions
    and their bytes, 70 entries per fingerprint; 32 bits decide a list, so lists stay short at any
    size of the corpus. In a list the shared bytes of a pair are tallied; the pair counts where the
    four are its first ones, and is verified on all bits. Lists over ``list_rows`` entries are split by four of
    the eight half-bytes that are left, which again loses no link and bounds every list by 65,536 entries. Lists
    of more than eight entries give a spanning forest of their links, so no group is written as all its pairs."""
    index = distinct.select("fp").mapInArrow(_postings, "key long, fp long")
    found = packed(index.repartition("key").sortWithinPartitions("key").mapInArrow(_tally(list_rows), _FOUND), len(_SETS) * distinct.count())
    near, hot = found.filter("not hot").select("a", "b"), found.filter("hot").select("key", F.col("a").alias("fp"))
    if hot.isEmpty():
        return near
    split = hot.mapInArrow(_split_postings, "key long, low long, fp long").repartition("key", "low").sortWithinPartitions("key", "low")
    return near.union(split.mapInArrow(_tally(None), _FOUND).select("a", "b"))


def groups(rows: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Adds component_id and component_row to ``numbered`` rows with id and fp: the smallest id (null last) that is reachable over
    links, and the first row that has it."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    distinct = packed(rows.groupBy("fp").agg(first.alias("first")), rows.count())
    roots = components(links(distinct, list_rows), len(_SETS) * distinct.count())
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    values = rooted.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("component_row"))
    return attach(rows, values, ["fp"])


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id (null last; the first of rows that share it), with the columns of ``docs``.

    Texts without words, null ones included, are one group. An empty table gives no rows."""
    row = fresh(docs, "row")
    held = reliable(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = held.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    slim = reliable(plain.mapInArrow(_row_fingerprints, "row long, id long, fp long").withColumn("node", F.shiftright("row", 33)))
    gone = groups(slim).filter("row <> component_row").select(F.col("row").alias(row))
    return held.join(gone, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def _row_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = next(_fingerprints(iter([pa.RecordBatch.from_arrays(batch.columns[1:], ["id", "text"])])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["row", "id", "fp"])


def op4(spark, sf_dir: str) -> DataFrame:
    found = groups(numbered(fingerprints(table(spark, sf_dir, "documents"))))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
