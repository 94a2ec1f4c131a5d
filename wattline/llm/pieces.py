"""Encoding of whole texts by pieces that are tokenized once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A space between two characters that are no white space always starts a match of the byte-level
# pattern, so a text is its pieces between such spaces, each (but the first) with the space before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")

# White space by the pattern: what \s means for a string.
_OTHER_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_BESIDE = [x for c in _OTHER_BLANKS if c in "\t\n\r\x0b\x0c" for x in (c + " ", " " + c)]
_RARE_BLANKS = re.compile("[" + "".join(c for c in _OTHER_BLANKS if c not in "\t\n\r\x0b\x0c") + "]")


def _plain(text: str) -> bool:
    """No space of the text is beside other white space or at an end."""
    return not ("  " in text or text[:1] == " " or text[-1:] == " " or any(x in text for x in _BESIDE)
                or not text.isascii() and _RARE_BLANKS.search(text))


class Recent:
    """Remembered values of strings in two generations, so that memory is bounded and frequent strings stay.

    A string that was forgotten is computed again; the bound changes the time only."""

    def __init__(self, limit_bytes: int):
        self._limit, self._size = limit_bytes, 0
        self._young, self._old = {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Keys without a value. All others can be looked up until ``turn``."""
        new = keys.difference(self._young)
        back = list(new & self._old.keys())
        self.learn(back, list(map(self._old.get, back)))
        new.difference_update(back)
        return list(new)

    def turn(self) -> None:
        """Forgets the older generation if the younger one is full."""
        if self._size > self._limit:
            self._old, self._young, self._size = self._young, {}, 0

    def clear(self) -> None:
        self._young, self._old, self._size = {}, {}, 0

    def learn(self, keys: list[str], values: list[bytes]) -> None:
        self._young.update(zip(keys, values, strict=True))
        self._size += sum(map(len, keys)) + sum(map(len, values)) + 180 * len(keys)  # with the objects around them

    @property
    def get(self) -> Callable[[str], bytes | None]:
        return self._young.get


class PieceEncoder:
    """Encodes whole texts by pieces that are tokenized once.

    ``tokenize`` gives the ids of words - matches of the byte-level pattern, with their space - as bytes and is called for many at
    once; ``split`` gives the words of a string. Texts are split, pieces numbered and ids gathered by Arrow and numpy; only the
    distinct pieces of a block become Python strings, and most of them are known already. A piece is known by its text without
    the space before it, and so is a word with a space."""

    def __init__(self, tokenize: Callable[[list[str]], list[bytes]], split: Callable[[str], list[str]], limit_bytes: int = 170 << 20):
        self._tokenize, self._split = tokenize, split
        self._known, self._bare = Recent(limit_bytes * 3 // 4), Recent(limit_bytes // 4)

    def clear(self) -> None:
        """Forgets all pieces and words."""
        self._known.clear()
        self._bare.clear()

    def run(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids (uint32) of the texts, in order."""
        for block in _blocks(texts):
            self._known.turn()
            self._bare.turn()
            plain = np.array([_plain(t) for t in block])
            out: list = [None] * len(block)
            for kind in (True, False):
                at = np.flatnonzero(plain == kind).tolist()
                own = [block[k] for k in at]
                if own:
                    pieces = pc.split_pattern(pa.array(own, pa.string()), " ") if kind else pa.array([_CUT.split(t) for t in own], pa.list_(pa.string()))
                    for k, ids in zip(at, self._encoded(pieces), strict=True):
                        out[k] = ids
            yield from out

    def _encoded(self, pieces: pa.ListArray) -> Iterator[np.ndarray]:
        """Ids of texts given as their pieces, the first of which has no space before it."""
        ends = pieces.offsets.to_numpy()
        numbered = pieces.flatten().dictionary_encode()
        strings, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy().astype(np.int64)
        heads = [self._split(strings[k]) for k in number[ends[:-1]]]
        inner = np.ones(len(number), bool)
        inner[ends[:-1]] = False
        used = np.bincount(number[inner], minlength=len(strings)) > 0
        get = self._known.get
        known = [get(s) if u else b"" for s, u in zip(strings, used.tolist(), strict=True)]
        if None in known:
            self._learn(self._known.missing({s for s, v in zip(strings, known, strict=True) if v is None}), heads)
            known = [get(s) if v is None else v for s, v in zip(strings, known, strict=True)]
        else:
            self._learn([], heads)
        known += map(self._joined, heads)
        number[ends[:-1]] = len(strings) + np.arange(len(heads))
        ids = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array(list(map(len, known)), np.int64) // 4
        start = np.cumsum(sizes) - sizes
        lengths = sizes[number]
        stops = np.cumsum(lengths)
        # the place of every id: where its piece starts, and how far it is into the piece
        gathered = ids[np.repeat((start[number] - stops + lengths).astype(np.int32), lengths) + np.arange(stops[-1] if len(stops) else 0, dtype=np.int32)]
        yield from np.split(gathered, stops[ends[1:-1] - 1])

    def _learn(self, pieces: list[str], heads: list[list[str]]) -> None:
        """Makes pieces known, and the words of them and of ``heads``."""
        spaced, bare, composed, split = set(), set(), [], self._split
        for piece in pieces:
            if piece.isalpha():  # str.isalpha is the pattern's class of letters
                spaced.add(piece)
                continue
            core = piece.rstrip(punctuation)
            if core.isalpha():  # a word with ASCII punctuation after it, which is one match
                spaced.add(core)
                bare.add(piece[len(core):])
                composed.append((piece, core, piece[len(core):]))
            else:
                composed.append((piece, None, split(" " + piece)))
        for found in [*heads, *(words for _, core, words in composed if core is None)]:
            for w in found:
                if w[:1] == " " and len(w) > 1:
                    spaced.add(w[1:])
                else:
                    bare.add(w)
        spaced, bare = self._known.missing(spaced), self._bare.missing(bare)
        encoded = self._tokenize([" " + w for w in spaced] + bare)
        self._known.learn(spaced, encoded[:len(spaced)])
        self._bare.learn(bare, encoded[len(spaced):])
        word, other = self._known.get, self._bare.get
        self._known.learn([c[0] for c in composed], [word(core) + other(rest) if core is not None else self._joined(rest) for _, core, rest in composed])

    def _joined(self, words: list[str]) -> bytes:
        word, other = self._known.get, self._bare.get
        return b"".join([word(w[1:]) if w[:1] == " " and len(w) > 1 else other(w) for w in words])


def _blocks(texts: list[str], size: int = 8 << 20) -> Iterator[list[str]]:
    block, held = [], 0
    for text in texts:
        block.append(text)
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block
