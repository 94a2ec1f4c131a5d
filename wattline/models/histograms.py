"""Regression trees grown from histograms of gradients and weights.

What decides a split are sums over the rows of a node by feature and bin. Targets are whole multiples of a power of two, so these sums
are exact, and a tree is the same whether one task has all rows or many tasks add up their parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass, field

import numpy as np

# Bits of a target: sums of 2 ** 22 rows stay exact in double precision.
TARGET_BITS = 29


@dataclass(frozen=True)
class Rule:
    """When a node is split. ``leaves`` asks for the best split of all open leaves first, up to that many leaves; without it trees grow
    level by level. ``l2`` is added to the weight of every node, ``least_rows`` and ``split_rows`` are weights of a
    side and of a node, ``least_gain`` must be exceeded."""

    depth: int | None = None
    leaves: int | None = None
    l2: float = 0.0
    least_rows: float = 1.0
    split_rows: float = 2.0
    least_gain: float = 0.0


@dataclass
class Tree:
    """Nodes in lists; a leaf has feature -1. ``g`` and ``h`` are the sums of gradients and weights of a node's rows."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    g: list[float] = field(default_factory=list)
    h: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, g: float, h: float, depth: int) -> int:
        for name, value in (("feature", -1), ("bin", 0), ("left", len(self.g)), ("right", len(self.g)), ("g", g), ("h", h), ("gain", 0.0), ("depth", depth)):
            getattr(self, name).append(value)
        return len(self.g) - 1

    def split(self, node: int, s: Split) -> tuple[int, int]:
        depth = self.depth[node] + 1
        self.feature[node], self.bin[node], self.gain[node] = s.feature, s.bin, s.gain
        self.left[node], self.right[node] = self.add(s.g, s.h, depth), self.add(self.g[node] - s.g, self.h[node] - s.h, depth)
        return self.left[node], self.right[node]

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of every row of bin codes."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(max(self.depth, default=0)):
            inner = feature[at] >= 0
            goes_left = codes[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        return at


@dataclass(frozen=True)
class Split:
    """A split of a node: rows with a code up to ``bin`` go left, where the sums are ``g`` and ``h``."""

    gain: float
    feature: int
    bin: int
    g: float
    h: float


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of the bins of a column but the last: its values at equal steps of its order."""
    ordered, n = np.sort(x), len(x)
    at = -(-n * np.arange(1, bins) // bins) - 1
    edges = np.unique(ordered[at[at >= 0]])
    return edges[edges < ordered[-1]] if n else edges


def bin_codes(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Number of edges under each value, by column."""
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16)


def target_scale(y: np.ndarray) -> float:
    """The power of two that makes targets whole numbers of TARGET_BITS bits."""
    top = float(np.abs(y).max(initial=0.0))
    return 2.0 ** (TARGET_BITS - np.ceil(np.log2(top))) if top > 0 else 1.0


def histograms(codes: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """Sums of g and h by (slot, feature, bin)."""
    d = codes.shape[1]
    key = (slot[:, None] * d + np.arange(d)) * bins + codes
    size = slots * d * bins
    return np.stack([np.bincount(key.ravel(), np.repeat(v, d), size) for v in (g, h)], -1).reshape(slots, d, bins, 2)


def best_splits(held: np.ndarray, scale: float, rule: Rule, columns: np.ndarray | None = None) -> list[Split | None]:
    """The best split of every slot of histograms; equal gains go to the first feature and bin. None where nothing may be split."""
    left = held.cumsum(2)
    gl, hl = left[..., 0] / scale, left[..., 1]
    g, h = gl[:, :1, -1:], hl[:, :1, -1:]
    gr, hr = g - gl, h - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + rule.l2) + gr * gr / (hr + rule.l2) - g * g / (h + rule.l2)
    good = (hl >= rule.least_rows) & (hr >= rule.least_rows) & (hl > 0) & (hr > 0) & (h >= rule.split_rows)
    if columns is not None:
        good &= columns[None, :, None]
    flat = np.where(good, gain, -np.inf).reshape(len(held), -1)
    out: list[Split | None] = []
    for k, at in enumerate(flat.argmax(1).tolist()):
        f, b = divmod(at, held.shape[2])
        out.append(Split(float(flat[k, at]), f, b, float(gl[k, f, b]), float(hl[k, f, b])) if flat[k, at] > rule.least_gain else None)
    return out


def sparse_splits(
    codes: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, bins: int, scale: float, rule: Rule, columns: np.ndarray | None = None
) -> list[Split | None]:
    """What ``best_splits`` gives for the histograms of these rows, from the bins that have rows only: with many small nodes most
    have none, and a bin without rows is never the first of its gain."""
    d = codes.shape[1]
    key = ((slot[:, None] * d + np.arange(d)) * bins + codes).ravel()
    order = np.argsort(key, kind="stable")
    key, row = key[order], order // d
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.stack([np.add.reduceat(v.astype(np.int64)[row], first) for v in (g, h)])
    key = key[first]
    group = key // bins  # (slot, feature)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff([*start, len(key)])
    run = np.concatenate([np.zeros((2, 1), np.int64), sums.cumsum(1)], 1)  # whole numbers, exact
    left = run[:, 1:] - np.repeat(run[:, start], size, 1)
    total = np.repeat(run[:, start + size] - run[:, start], size, 1)
    gl, hl, g_all, h_all = left[0] / scale, left[1].astype(float), total[0] / scale, total[1].astype(float)
    gr, hr = g_all - gl, h_all - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + rule.l2) + gr * gr / (hr + rule.l2) - g_all * g_all / (h_all + rule.l2)
    good = (hl >= rule.least_rows) & (hr >= rule.least_rows) & (hl > 0) & (hr > 0) & (h_all >= rule.split_rows)
    if columns is not None:
        good &= columns[group % d]
    gain = np.where(good, gain, -np.inf)
    of_slot = group // d
    starts = np.flatnonzero(np.concatenate([[True], of_slot[1:] != of_slot[:-1]]))
    top = np.maximum.reduceat(gain, starts)
    hits = np.flatnonzero((gain == np.repeat(top, np.diff([*starts, len(key)]))) & (gain > rule.least_gain))
    out: list[Split | None] = [None] * slots
    for at in hits[::-1].tolist():  # the first of equal gains is set last
        out[int(of_slot[at])] = Split(float(gain[at]), int(group[at] % d), int(key[at] % bins), float(gl[at]), float(hl[at]))
    return out


def grow(root: tuple[float, float], rule: Rule, split: Callable[[Tree, list[int]], list[Split | None]]) -> Tree:
    """Grows a tree. ``split`` gives the best splits of open nodes of the tree as it is, for all nodes of a level, or, where leaves
    are limited, for the two children of the leaf that was split last."""
    tree = Tree()
    tree.add(*root, 0)
    deep = lambda node: rule.depth is not None and tree.depth[node] >= rule.depth
    if rule.leaves is None:
        level = [0]
        while level := [n for n in level if not deep(n)]:
            found = split(tree, level)
            level = [child for node, s in zip(level, found, strict=True) if s for child in tree.split(node, s)]
        return tree
    queue: list[tuple[float, int, Split]] = []
    fresh, leaves = [0], 1
    while True:
        open_nodes = [n for n in fresh if not deep(n)]
        for node, s in zip(open_nodes, split(tree, open_nodes) if open_nodes else [], strict=True):
            if s:
                heapq.heappush(queue, (-s.gain, node, s))
        if not queue or leaves >= rule.leaves:
            return tree
        _, node, s = heapq.heappop(queue)
        fresh, leaves = list(tree.split(node, s)), leaves + 1


def growing(root: tuple[float, float], rule: Rule) -> Generator[tuple[Tree, list[int]], list[Split | None], Tree]:
    """The tree of ``grow``, step by step: yields a tree with open nodes and takes their best splits. Where leaves are limited, the
    children of all leaves that may still be split are asked for together, so the steps are about as many as levels."""
    tree = Tree()
    tree.add(*root, 0)
    if rule.leaves is None:
        level = [0]
        while level := [n for n in level if rule.depth is None or tree.depth[n] < rule.depth]:
            found = yield tree, level
            level = [child for node, s in zip(level, found, strict=True) if s for child in tree.split(node, s)]
        return tree
    wide, known = tree, {0: None} if rule.depth == 0 else {}
    asked = [] if known else [0]
    while True:
        if asked:
            found = yield wide, asked
            known |= dict(zip(asked, found, strict=True))
        tree, asked = _best_first(root, rule, wide, known)
        if not asked:
            return tree


def _best_first(root: tuple[float, float], rule: Rule, wide: Tree, known: dict[int, Split | None]) -> tuple[Tree, list[int]]:
    """The tree as far as known splits of the nodes of ``wide`` go, and the nodes to be known next: none where it is whole."""
    tree, place, queue, fresh, leaves = Tree(), [0], [], [0], 1
    tree.add(*root, 0)
    while True:
        for node in fresh:
            if s := known[place[node]]:
                heapq.heappush(queue, (-s.gain, node, s))
        if not queue or leaves >= rule.leaves:
            return tree, []
        _, node, s = queue[0]
        at = place[node]
        if leaves + 1 < rule.leaves and (wide.feature[at] < 0 or not {wide.left[at], wide.right[at]} <= known.keys()):
            asked = []
            for _, leaf, own in heapq.nsmallest(rule.leaves - 1 - leaves, queue):
                at = place[leaf]
                children = wide.split(at, own) if wide.feature[at] < 0 else (wide.left[at], wide.right[at])
                for child in children:
                    if rule.depth is not None and wide.depth[child] >= rule.depth:
                        known[child] = None
                    elif child not in known:
                        asked.append(child)
            if asked:
                return tree, asked
        heapq.heappop(queue)
        fresh, leaves = list(tree.split(node, s)), leaves + 1
        if leaves >= rule.leaves:
            return tree, []
        place += [wide.left[place[node]], wide.right[place[node]]]


class LocalRows:
    """Binned rows of one task; keeps the node of every row and, where leaves are limited, the histograms of open leaves."""

    def __init__(self, codes: np.ndarray, bins: int, scale: float):
        self.codes, self.bins, self.scale = codes, bins, scale

    def tree(self, g: np.ndarray, h: np.ndarray, rule: Rule, columns: np.ndarray | None = None) -> Tree:
        """A tree for whole gradients g and weights h."""
        used = np.flatnonzero(h)
        codes, g, h = self.codes[used], g[used].astype(float), h[used].astype(float)
        at = np.zeros(len(used), np.int64)
        held: dict[int, np.ndarray] = {}

        def send(tree: Tree, node: int) -> None:
            """Rows of a node that was split go to its children."""
            rows = np.flatnonzero(at == node)
            at[rows] = np.where(codes[rows, tree.feature[node]] <= tree.bin[node], tree.left[node], tree.right[node])

        def level(tree: Tree, nodes: list[int]) -> list[Split | None]:
            feature, cut, left, right = (np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.right))
            moved = feature[at] >= 0
            goes_left = codes[np.arange(len(at)), np.maximum(feature[at], 0)] <= cut[at]
            at[:] = np.where(moved, np.where(goes_left, left[at], right[at]), at)
            slot = np.full(len(tree.g), -1)
            slot[nodes] = np.arange(len(nodes))
            mine = slot[at]
            rows = np.flatnonzero(mine >= 0)
            if len(rows) and len(nodes) * self.bins > 2 * len(rows):
                return sparse_splits(codes[rows], mine[rows], g[rows], h[rows], len(nodes), self.bins, self.scale, rule, columns)
            return best_splits(histograms(codes[rows], mine[rows], g[rows], h[rows], len(nodes), self.bins), self.scale, rule, columns)

        def leaf(tree: Tree, nodes: list[int]) -> list[Split | None]:
            one = lambda rows: histograms(codes[rows], np.zeros(len(rows), np.int64), g[rows], h[rows], 1, self.bins)[0]
            if len(tree.g) == 1:
                held[0] = one(np.arange(len(at)))
            for parent in [n for n in held if tree.feature[n] >= 0]:
                send(tree, parent)
                a, b = tree.left[parent], tree.right[parent]
                if (at == a).sum() > (at == b).sum():
                    a, b = b, a
                held[a] = one(np.flatnonzero(at == a))
                held[b] = held.pop(parent) - held[a]  # what the smaller side does not have
            return best_splits(np.stack([held[n] for n in nodes]), self.scale, rule, columns)

        return grow((float(g.sum()) / self.scale, float(h.sum())), rule, level if rule.leaves is None else leaf)


def uniform(rows: np.ndarray, *keys: int) -> np.ndarray:
    """A number in [0, 1) for every row number, fixed by it and the keys."""
    x = rows.astype(np.uint64)
    for k in keys:
        x = (x ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x = x * np.uint64(0x94D049BB133111EB) + np.uint64(k + 1)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)) / float(1 << 53)


def poisson(u: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) to draws with mean one: how often a row is in a sample of its own size, with replacement."""
    edges = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(edges, u, "right").astype(float)
