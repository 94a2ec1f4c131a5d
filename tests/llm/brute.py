"""Plain versions of the operators, row by row."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANKS = "[\x20\x09-\x0d]+"
WORDS = "[^\x20\x09-\x0d]+"


def key(value):
    """Nulls last."""
    return (value is None, value if value is not None else 0)


def words(text):
    return re.findall(WORDS, text or "")


def shards(rows, n=16):
    """(doc_id, size) in input order to (doc_id, size, shard, slot)."""
    ordered = sorted(rows, key=lambda r: key(r[0]))
    total, before, out, slots = sum(r[1] for r in rows), 0, [], Counter()
    for doc_id, size in ordered:
        shard = min(n - 1, n * (2 * before + size) // (2 * total))
        out.append((doc_id, size, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def exact(rows):
    """(doc_id, text) to (doc_id, keep_id, group_size, kept, sha256)."""
    groups, digests = defaultdict(list), []
    for k, (doc_id, text) in enumerate(rows):
        digests.append(hashlib.sha256(re.sub(BLANKS, " ", text or "").encode()).hexdigest())
        groups[digests[-1]].append(k)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        own = groups[digests[k]]
        keep = min(own, key=lambda j: (key(rows[j][0]), j))
        out.append((doc_id, rows[keep][0], len(own), keep == k, digests[k]))
    return out


def simhash(text):
    found = [w.encode() for w in words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not found:
        return 0
    shingles = [b" ".join(found[k:k + 4]) for k in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(fps, most=4):
    """Root (smallest position) of every fingerprint under links of ``most`` bits."""
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    a = np.array(fps, np.uint64)
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1:] ^ a[k]) <= most) + k + 1:
            x, y = find(k), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(a))]


def near(rows):
    """(doc_id, text) to (doc_id, fingerprint, component_id, first of its component)."""
    fps = [simhash(text) for _, text in rows]
    roots = linked(fps)
    first = {}
    for k, r in enumerate(roots):
        if r not in first or (key(rows[k][0]), k) < (key(rows[first[r]][0]), first[r]):
            first[r] = k
    return [(doc_id, f"{fp:016x}", rows[first[r]][0], first[r] == k) for k, ((doc_id, _), fp, r) in enumerate(zip(rows, fps, roots, strict=True))]


def similar_rows(rows, id_at=0, text_at=1, size=5):
    """Rows that stay when texts link at 0.8 of their word shingles: those of the smallest id (null last), the first of equal ones."""
    sets = []
    for r in rows:
        found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[text_at] or ""))
        sets.append(frozenset(tuple(found[k:k + size]) for k in range(max(1, len(found) - size + 1))) if found else frozenset())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for j in range(len(rows)):
        for k in range(j):
            both = len(sets[j] & sets[k])
            if sets[j] == sets[k] or 5 * both >= 4 * (len(sets[j]) + len(sets[k]) - both):
                x, y = find(j), find(k)
                root[max(x, y)] = min(x, y)
    first = {}
    for k in range(len(rows)):
        r = find(k)
        if r not in first or key(rows[k][id_at]) < key(rows[first[r]][id_at]):
            first[r] = k
    return [rows[k] for k in sorted(first.values())]


def similar_kept(rows):
    return sorted(r[0] for r in similar_rows(rows))


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Source sizes to targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def mix(rows, seed="mix-1"):
    """(doc_id, source, text) to (doc_id, size, source_size, target, copies)."""
    sizes = [len(words(t)) for _, _, t in rows]
    total = Counter()
    for (_, s, _), n in zip(rows, sizes, strict=True):
        total[s] += n
    target = targets(dict(total)) if rows else {}
    hashed = [hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest() for d, _, _ in rows]
    before, out = Counter(), [None] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (hashed[k], sizes[k], k)):
        doc_id, s, _ = rows[k]
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        copies = epochs + (2 * before[s] + sizes[k] < 2 * (target[s] - epochs * total[s]))
        before[s] += sizes[k]
        out[k] = (doc_id, sizes[k], total[s], target[s], copies)
    return out


def base_counts(text):
    text = text or ""
    found = words(text)
    windows = [tuple(found[k:k + 5]) for k in range(len(found) - 4)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if words(line):
            copies += line in seen
            seen.add(line)
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), copies, len(inside))


def grams(text, n=4, bits=18):
    data = (text or "").encode()
    return [((int.from_bytes(data[k:k + n], "big") * 2654435761) % (1 << 32)) >> (32 - bits) for k in range(len(data) - n + 1)]


def log_ratios(rows, trusted, prior=10_000.0):
    """(doc_id, text) to mean log ratios, over a table of ratios of the two multinomials."""
    corpus, target = Counter(), Counter()
    for doc_id, text in rows:
        corpus.update(grams(text))
        if doc_id in trusted:
            target.update(grams(text))
    n, m = sum(corpus.values()), sum(target.values())
    if not n or not m:
        return [0.0] * len(rows)
    ratio = {b: math.log((target[b] + prior * c / n) / ((m + prior) * c / n)) for b, c in corpus.items()}
    return [sum(ratio[b] for b in g) / len(g) if (g := grams(text)) else 0.0 for _, text in rows]


def crc(data):
    return zlib.crc32(data)
