"""Plain versions of the operators, for small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def removed_bytes(docs, window=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        count.update(b[p : p + window] for p in range(len(b) - window + 1))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p + 1 : p + 1 + window] = True
        flags = gone[1:-1]
        kept = bytes(np.frombuffer(b, np.uint8)[~flags])
        out[i] = (len(b), int(flags.sum()), int((np.diff(gone.astype(int)) == 1).sum()), sha(kept))
    return out


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else (tuple(w[k : k + width]) for k in range(len(w) - width + 1)))


def components(docs, width, percent):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_dedup(docs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    where = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= min_docs and i != max(where[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    return out


def pieces(docs, tokenizer, places=2048):
    """(doc_id, piece) -> (start, length, ids_crc32)."""
    out = {}
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), places):
            part = ids[k : k + places]
            out[i, k // places] = (k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    return out


def best_fit_bins(lengths, places=2048):
    """Number of bins of best-fit decreasing, every open bin looked at."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(left) if room >= n]
        if fit:
            best = min(fit, key=lambda k: left[k])
            left[best] -= n
        else:
            left.append(places - n)
    return len(left)


def mix_targets(sizes, weights=(3, 1, 2)):
    """source -> target: 150 % of all words by weight, at most twice the source, the excess shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over
