"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table
from .pieces import PieceEncoder

# What a task remembers of words and pieces.
CACHE_BYTES = 64 << 20
_OUT = "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _array(numbers: np.ndarray) -> array:
    return array("i", numbers.astype(np.int32).tobytes())


class MergeReplay:
    """Encodes many words at once by replaying the merges of a rank file over all of them.

    An inverted index leads from the rank of a token pair to the positions where the pair stands. Ranks are applied
    in order over all words; a merge touches its two neighbours only, whose new pairs enter the index. Should
    a merge make a pair of a lower rank than its own, that word is encoded again by itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        width = 1 + max(ranks.values())
        self.width = width
        self.pairs = {}
        self._byte_ids = np.array(self.bytes)
        top = max(self.bytes) + 1
        self._byte_pairs = np.full((top, top), -1)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a * width + b] = rank
                    if len(token) == 2:
                        self._byte_pairs[a, b] = rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        width, pair_rank = self.width, self.pairs.get
        # All words in one chain; -1 keeps them apart and belongs to no pair.
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes)
        first = ends - sizes + 1
        chain = np.full(int(ends[-1]) + 1, -1, np.int64)
        inside = np.ones(len(chain), bool)
        inside[0] = inside[ends] = False
        chain[inside] = self._byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(chain), -1, np.int64)
        rank[:-1] = np.where((chain[:-1] >= 0) & (chain[1:] >= 0), self._byte_pairs[np.maximum(chain[:-1], 0), np.maximum(chain[1:], 0)], -1)
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        found, starts = np.unique(rank[places], return_index=True)
        # Arrays, as lists hold a Python number for every place: 192 bytes for a byte of the words, 64 with arrays.
        index = defaultdict(lambda: array("i"), {int(r): _array(p) for r, p in zip(found, np.split(places, starts[1:]), strict=True)} if len(places) else {})
        token, stands, end, again = _array(chain), _array(rank), len(chain), set()
        after, before = _array(np.arange(1, end + 1)), _array(np.arange(-1, end - 1))
        del chain, rank, inside, places
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            for p in sorted(positions):  # leftmost first
                if stands[p] != rank:
                    continue
                gone = after[p]
                token[p], q = rank, after[gone]
                stands[gone] = -1
                token[gone] = -2
                after[p], before[q] = q, p
                right = pair_rank(rank * width + token[q]) if token[q] >= 0 else None
                left = before[p]
                least = pair_rank(token[left] * width + rank) if token[left] >= 0 else None
                for at, new in ((p, right), (left, least)):
                    if new is None:
                        stands[at] = -1
                        continue
                    stands[at] = new
                    if new not in index:
                        heapq.heappush(heap, new)
                    index[new].append(at)
                    if new < rank:
                        again.add(at)
        out, starts = [], first.tolist()
        redo = self._words_at(again, first) if again else ()
        for n, word in enumerate(words):
            if n in redo:
                out.append(self._alone(word))
                continue
            p, own = starts[n], []
            while token[p] >= 0:
                own.append(token[p])
                p = after[p]
            out.append(own)
        return out

    @staticmethod
    def _words_at(positions: set, first: np.ndarray) -> set:
        return set((np.searchsorted(first, np.array(sorted(positions)), side="right") - 1).tolist())

    def _alone(self, word: bytes) -> list[int]:
        """One word, the lowest and leftmost pair first."""
        ids = [self.bytes[b] for b in word]
        while len(ids) > 1:
            ranked = [(self.pairs.get(a * self.width + b, self.width), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            rank, k = min(ranked)
            if rank == self.width:
                break
            ids[k:k + 2] = [rank]
        return ids


class Codec:
    """Encoder and decoder of whole texts for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces = PieceEncoder(self._tokenize, self.pattern.findall, CACHE_BYTES)

    def _tokenize(self, words: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.replay.encode([w.encode() for w in words])]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.pieces.run(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for a Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _coder(path: str, pattern: str, with_ids: bool):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts, sums, decoded, held = [], [], [], []
            for ids in own.encode(texts):
                counts.append(len(ids))
                sums.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    held.append(ids)
            made = [pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                flat = np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32)
                made.insert(0, pa.LargeListArray.from_arrays(offsets, flat).cast(pa.list_(pa.int32())))
                names.insert(0, "ids")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *names])
        own.pieces.clear()
        release()

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` with ids, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the
    bytes that the ids decode to) of every whole text. Without ``with_ids`` the ids are left out.

    A task takes its slice of the corpus in blocks, finds the distinct words that it has not seen, and replays the
    merges over all of them at once; texts are then put together from their pieces. Nothing is shuffled. Null and empty texts
    have no ids. ``keep`` may not hold the names of the new columns. Repeated rows and an empty table need no care."""
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)
    made = _OUT if with_ids else _OUT.partition(", ")[2]
    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(_coder(path, pattern, with_ids), ", ".join(filter(None, [fields, made])))


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
