"""Codes by pivots against plain rounds over all entries, in Python numbers."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np

from itemspark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, gaps int, code string, error int"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Sorted (vec_id, code, error, label_error) and the digest, by looking at every entry."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    numbers = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    dim = len(numbers[0])
    cuts = [dim * k // parts for k in range(parts + 1)]
    cut = [[v[a:b] for v in numbers] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    books = [x[:entries] for x in cut]

    def assigned(k):
        out = []
        for x in cut[k]:
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[k])))
        return out

    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for x, (_, j) in zip(cut[k], assigned(k), strict=True):
                members[j].append(x)
            books[k] = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else e for j, e in enumerate(books[k])]
    last = [assigned(k) for k in range(parts)]
    code = ["".join(f"{j:02x}" for _, j in row) for row in zip(*last, strict=True)]
    error = [sum(d for d, _ in row) for row in zip(*last, strict=True)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label]) for (i, _, label), c, e in zip(kept, code, error, strict=True)), key=repr), digest


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "c", 3) for r in rows], SCHEMA).repartition(4)
    out = vector_codes.compress(frame, **more).collect()
    digests = {r.codebooks_sha256 for r in out}
    return sorted(((r.id, r.code, r.error, r.label_error) for r in out), key=repr), digests


def draws(n, dim, seed=1, spread=1.0):
    draw = np.random.default_rng(seed)
    middles = draw.normal(0, spread, (9, dim))
    return [(int(k * 3), [float(x) for x in middles[k % 9] + draw.normal(0, spread / 5, dim)], [None, 1, 2][k % 3]) for k in range(n)]


def test_against_all_entries(spark):
    rows = draws(330, 8) + [(2, None, 1), (4, [1.0] * 7 + [None], 1), (5, [float("nan")] + [0.0] * 7, 2), (7, [float("inf")] + [0.0] * 7, 2)]
    rows += [(None, [0.25] * 8, None), (9, rows[3][1], 5), (9, rows[3][1], 5)]  # a null id, repeated rows, ties
    want, digest = plain(rows)
    assert got(spark, rows) == (want, {digest})


def test_fewer_vectors_than_entries_and_uneven_parts(spark):
    rows = draws(20, 7)
    want, digest = plain(rows, entries=6, rounds=3)
    assert got(spark, rows, entries=6, rounds=3, pivots=2) == (want, {digest})


def test_very_large_components(spark):
    rows = draws(40, 4, spread=1e5) + [(1000 + k, [1e30, -3.5e37, 1e30 * k, 0.5], 9) for k in range(3)]
    want, digest = plain(rows, entries=8)
    want = sorted(((i, c, e if e < 1 << 63 else None, s) for i, c, e, s in want), key=repr)
    found, digests = got(spark, rows, entries=8)
    assert digests == {digest} and [r[:3] for r in found] == [r[:3] for r in want]


def test_vectors_of_another_length_keep_their_row(spark):
    rows = draws(12, 8)
    found, _ = got(spark, [*rows, (500, [0.5, 0.5], 1), (501, [], 7)], entries=4)
    want, _ = plain(rows, entries=4)
    extra = [r for r in found if r[0] in (500, 501)]
    assert [r for r in found if r not in extra] == want
    label = next(r[3] for r in want if r[0] == 3)  # the errors of label 1
    assert sorted(extra) == [(500, None, None, label), (501, None, None, None)]


def test_only_empty_vectors(spark):
    assert got(spark, [(1, [], 1), (2, None, 1)])[0] == [(1, None, None, None)]


def test_pivots_save_evaluations():
    draw = np.random.default_rng(5)
    middles = draw.integers(-5000, 5000, (256, 4))
    parts = middles[draw.integers(0, 256, 600)] + draw.integers(-40, 40, (600, 4))
    pivots = vector_codes.far_pivots(middles, 16)
    to_pivots = vector_codes._root(vector_codes._square(parts[:, None, :], pivots[None]))
    links = vector_codes._root(vector_codes._square(pivots[:, None, :], middles[None]))
    index, best, tried = vector_codes.nearest(parts, to_pivots, middles, links)
    every = vector_codes._square(parts[:, None, :], middles[None])
    assert index.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()
    assert tried < every.size // 10


def test_many_labels_beside_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 1)
    rows = [(k, [float(k % 7)] * 4, None if k % 2 else k % 5) for k in range(60)]
    want, digest = plain(rows, entries=3)
    assert got(spark, rows, entries=3) == (want, {digest})
