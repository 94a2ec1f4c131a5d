"""Token identifiers in files of patched frame-of-reference blocks."""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import create, file_system, new_folder, reliable, table
from .pieces import PieceEncoder

BLOCK = 1024
PERCENTILE = 98
END = 0
FILE_TOKENS = 64 << 20
# Fixed values of the file format, version 1. All numbers are little-endian.
#   magic | blocks | doc ids (int64) | null marks (uint8) | token counts (int64) | block starts (int64) | footer | footer size | magic
#   block: values (uint16), width (uint8), minimum (uint32), outliers (uint16), packed low bits,
#          outlier places (uint16 each), outlier high bits (uint32 each)
MAGIC = b"PFOR0001"
_HEAD = np.dtype([("n", "<u2"), ("width", "u1"), ("least", "<u4"), ("outliers", "<u2")])


def _widths(differences: np.ndarray, percentile: int) -> np.ndarray:
    """Bits that hold the value at the percentile of each row."""
    at = min(differences.shape[1] - 1, -(-differences.shape[1] * percentile // 100) - 1)
    value = np.partition(differences, at, axis=1)[:, at].astype(np.float64)
    return np.where(value > 0, np.floor(np.log2(np.maximum(value, 1))) + 1, 0).astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers under 2**width as rows of bytes, high bits first."""
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    spread = np.unpackbits(values.astype(kind).view(np.uint8).reshape(len(values), -1), axis=1)
    return np.packbits(spread.reshape(len(values), -1, bits)[:, :, bits - width:].reshape(len(values), -1), axis=1)


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of ``pack`` for rows of ``n`` numbers."""
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    spread = np.zeros((len(data), n, bits), np.uint8)
    spread[:, :, bits - width:] = np.unpackbits(data, axis=1, count=n * width).reshape(len(data), n, width)
    return np.packbits(spread.reshape(len(data), -1), axis=1).view(kind).astype(np.uint32)


def encode_blocks(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of uint32 ``values``, one per row: the minimum is subtracted, low bits are packed at the width of the percentile, and the
    high bits of what does not fit go to the outlier lists."""
    least = values.min(1)
    difference = values - least[:, None]
    widths = _widths(difference, percentile)
    out: list[bytes] = [b""] * len(values)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        own = difference[rows]
        high = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
        packed = pack(own & np.uint32((1 << width) - 1), width) if width else np.zeros((len(rows), 0), np.uint8)
        spoiled = high.any(1)
        for k, row in enumerate(rows.tolist()):
            places = np.flatnonzero(high[k]) if spoiled[k] else np.zeros(0, np.int64)
            head = np.array([(values.shape[1], width, least[row], len(places))], _HEAD).tobytes()
            out[row] = head + packed[k].tobytes() + places.astype("<u2").tobytes() + high[k, places].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that start at ``starts`` in ``data``, in order."""
    heads = [np.frombuffer(data, _HEAD, 1, s)[0] for s in starts.tolist()]
    n = np.array([h["n"] for h in heads], np.int64)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, h in enumerate(heads):
        alike.setdefault((int(h["n"]), int(h["width"])), []).append(k)
    whole = np.frombuffer(data, np.uint8)
    for (count, width), rows in alike.items():
        size = -(-count * width // 8)
        at = starts[rows] + _HEAD.itemsize
        low = unpack(whole[at[:, None] + np.arange(size)], width, count) if width else np.zeros((len(rows), count), np.uint32)
        for k, row in enumerate(rows):
            h = heads[row]
            if h["outliers"]:
                m, p = int(h["outliers"]), int(at[k]) + size
                places = np.frombuffer(data, "<u2", m, p)
                low[k, places] |= np.frombuffer(data, "<u4", m, p + 2 * m) << np.uint32(width)
            out[ends[row] - count:ends[row]] = low[k] + h["least"]
    return out


class TokenFileWriter:
    """Writes documents in order to one file. Only the last, unfinished block group waits in memory."""

    def __init__(self, stream, block: int = BLOCK, percentile: int = PERCENTILE):
        self._stream, self._block, self._percentile = stream, block, percentile
        self._ids, self._nulls, self._counts, self._starts = [], [], [], []
        self._held, self._n, self._at = [], 0, len(MAGIC)
        self.tokens = self.docs = 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._ids.append(doc_id or 0)
        self._nulls.append(doc_id is None)
        self._counts.append(len(ids))
        self._held.append(ids)
        self._n += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        if self._n >= 256 * self._block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self._held).astype(np.uint32) if self._held else np.zeros(0, np.uint32)
        full = len(values) // self._block * self._block
        blocks = encode_blocks(values[:full].reshape(-1, self._block), self._percentile) if full else []
        if last and full < len(values):
            blocks += encode_blocks(values[None, full:], self._percentile)
            full = len(values)
        for b in blocks:
            self._starts.append(self._at)
            self._at += len(b)
        self._stream.write(b"".join(blocks))
        self._held, self._n = [values[full:]], len(values) - full

    def close(self) -> int:
        """Writes the tables at the end; the size of the file."""
        self._flush(True)
        tables = [np.array(self._ids, "<i8"), np.array(self._nulls, "u1"), np.array(self._counts, "<i8"), np.array(self._starts, "<i8")]
        footer = json.dumps({"docs": self.docs, "blocks": len(self._starts), "block": self._block, "tokens": self.tokens, "tables": self._at}).encode()
        self._stream.write(b"".join(t.tobytes() for t in tables) + footer + len(footer).to_bytes(8, "little") + MAGIC)
        self._stream.close()
        return self._at + sum(t.nbytes for t in tables) + len(footer) + 16


class TokenFileReader:
    """Random access to a file by documents or by tokens; reads only the blocks that hold them."""

    def __init__(self, uri: str):
        store, path = file_system(uri)
        self._file = store.open_input_file(path)
        size = self._file.size()
        tail = self._file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self._file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        length = int.from_bytes(tail[:8], "little")
        self.footer = f = json.loads(self._file.read_at(length, size - 16 - length))
        data = self._file.read_at(size - 16 - length - f["tables"], f["tables"])
        d, b = f["docs"], f["blocks"]
        self.doc_ids, self.nulls = np.frombuffer(data, "<i8", d), np.frombuffer(data, "u1", d, 8 * d).astype(bool)
        self.counts, self._starts = np.frombuffer(data, "<i8", d, 9 * d), np.frombuffer(data, "<i8", b, 17 * d)
        self.ends = np.cumsum(self.counts)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        size = self.footer["block"]
        first, last = start // size, -(-stop // size)
        low = int(self._starts[first])
        high = int(self._starts[last]) if last < len(self._starts) else self.footer["tables"]
        values = decode_blocks(self._file.read_at(high - low, low), self._starts[first:last] - low)
        return values[start - first * size:stop - first * size]

    def documents(self, group: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first token in the file, its tokens), about ``group`` tokens read at a time."""
        k = 0
        while k < len(self.ends):
            start = int(self.ends[k] - self.counts[k])
            last = max(k + 1, int(np.searchsorted(self.ends, start + group, side="right")))
            values = self.tokens(start, int(self.ends[last - 1]))
            for d in range(k, last):
                at = int(self.ends[d] - self.counts[d])
                yield None if self.nulls[d] else int(self.doc_ids[d]), at, values[at - start:at - start + int(self.counts[d])]
            k = last

    def close(self) -> None:
        self._file.close()


# Fixed value: the pattern of a byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Tokenizer:
    """Whole texts by a byte-level tokenizer file: its model encodes each distinct word once."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        file = json.loads(tokenizer.to_str())
        before, added = file["pre_tokenizer"], file["added_tokens"]
        if tokenizer.normalizer is not None or before != before | {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that depend on what is beside them")
        self._added = {t["content"]: np.array([t["id"]], np.uint32) for t in added}
        # the longest of those that start at a place
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self._model = tokenizer.model
        # Bytes are spelled as letters: printable ones as they are, the others from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self._spelled = dict(zip([b for b in range(256) if b not in plain], range(256, 512), strict=False))
        self._space = " ".translate(self._spelled)
        self.pieces = PieceEncoder(self._tokenize, regex.compile(BYTE_LEVEL).findall)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of the texts as the library gives them: added tokens are cut out first, and what lies between is encoded by itself."""
        parts = [[p for p in self._cut.split(t) if p] if any(a in t for a in self._added) else [t] for t in texts]
        between = self.pieces.run([p for own in parts for p in own if p not in self._added])
        for own in parts:
            ids = [self._added[p] if p in self._added else next(between) for p in own]
            yield ids[0] if len(ids) == 1 else np.concatenate(ids)

    def _spelling(self, word: str) -> str:
        if word.isascii() and word[1:].isalpha() and word[0] == " ":
            return self._space + word[1:]
        return word.encode().decode("latin-1").translate(self._spelled)

    def _tokenize(self, words: list[str]) -> list[bytes]:
        tokenize = self._model.tokenize
        return [array("I", [t.id for t in tokenize(s)]).tobytes() for s in map(self._spelling, words)]


@functools.cache
def tokenizer(path: str) -> _Tokenizer:
    """One tokenizer for a Python worker."""
    return _Tokenizer(path)


def _writer(folder: str, path: str, block: int, percentile: int, file_tokens: int, added_tokens: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tokenizer, task = tokenizer(path), TaskContext.get()
        encode = own_tokenizer.encode if added_tokens else own_tokenizer.pieces.run
        end, number, out, name = np.array([END], "<u4"), 0, None, ""

        def done():
            size = out.close()
            return pa.RecordBatch.from_pylist([{"part": task.partitionId(), "number": number, "path": name, "docs": out.docs, "tokens": out.tokens, "bytes": size}])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, own in zip(ids, encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                if out is None:
                    # a new name for each attempt: a repeated task leaves no mixed file
                    name = f"{folder}/tokens-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.pfor"
                    out = TokenFileWriter(create(name), block, percentile)
                out.add(doc_id, np.concatenate([own, end]))
                if out.tokens >= file_tokens:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                 block: int = BLOCK, percentile: int = PERCENTILE, file_tokens: int = FILE_TOKENS, added_tokens: bool = False) -> DataFrame:
    """Writes the ids of all texts in ascending order of doc_id, each text followed by id 0, and returns the manifest: part, number, path,
    docs, tokens, bytes and start (tokens in all files before).

    Rows are range-partitioned by doc_id (nulls last; rows that share one keep the input's order and may spread over files); each task
    streams its range into files. Files of lost or repeated attempts are not in the manifest. Null and empty texts have
    id 0 alone. An empty table writes no file. With ``added_tokens`` the tokenizer's added tokens get their own ids where a text holds
    them, as in the library's default; without, they are text like any other (the library's ``encode_special_tokens``)."""
    order = [F.asc_nulls_last("doc_id"), F.col("row")]
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    placed = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = reliable(placed.mapInArrow(_writer(folder, tokenizer_path, block, percentile, file_tokens, added_tokens),
                                          "part long, number long, path string, docs long, tokens long, bytes long"))
    # one row per file
    before = Window.partitionBy(F.lit(0)).orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            doc_ids, starts, counts, sums, ids = zip(*rows, strict=True)
            columns = [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for files in batches:
            for path, start in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                reader, rows, held = TokenFileReader(path), [], 0
                for doc_id, at, ids in reader.documents():
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), ids))
                    held += len(ids)
                    if held > 2 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
                reader.close()

    return read


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids of every document."""
    files = max(1, manifest.count())
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.select("path", "start").repartition(files).mapInArrow(_reader(with_ids), fields)


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return read_tokens(manifest, with_ids=False)
