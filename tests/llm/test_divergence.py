"""The sparse merge per pair of sources against a plain version."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER

from itemspark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n int, v int, block int, id string, held int"


def plain(rows, min_docs=10, top=10):
    """(lang, source, part, item) -> (value, rank) by the definition, for every term of every pair."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for _, _, terms in own for t in set(terms))
        kept = {t for t, n in in_docs.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())

        def shares(c):
            below = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // below for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)

        def price(a, b):
            return (a - b) ** 2 // (a + b)

        for a in counts:
            found = {"pair": [(b, sum(price(p[a][t], p[b][t]) for t in kept)) for b in counts if b != a]}
            found["term"] = [(t, price(p[a][t], q[t])) for t in counts[a] if counts[a][t] and p[a][t] > q[t]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for rank, (item, value) in enumerate(items, 1):
                    if part == "pair" or rank <= top:
                        out[lang, a, part, item] = (value, rank)
    return out


def got(spark, rows, **more):
    docs = spark.createDataFrame([(k, *r, 1, 2, 3, "x", 4) for k, r in enumerate(rows)], SCHEMA).repartition(5)
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.divergence(docs, **more).collect()}


def some_rows():
    draw = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{'é' * (k // 26)}" for k in range(70)]
    rows = []
    for k in range(260):
        source = ["hot", "hot", "b", None, "", "ü", "rare"][int(draw.integers(0, 7))] if k != 7 else "alone"
        lang = ["en", "fr", None][int(draw.integers(0, 3))]
        size = int(draw.integers(0, 40))
        text = None if k % 29 == 0 else " ".join(words[int(abs(draw.normal(0, 20))) % 70] for _ in range(size)).title()
        rows.append((text, lang, source))
    return rows + [("only here 1-2_3", "zz", "one"), (None, "zz", "two"), ("", "zz", "three"), ("x", "single", "s")] + [("tie tIe TIE", "tt", s) for s in "ab" for _ in range(10)]


@pytest.mark.parametrize("sizes", [(1 << 14, 16), (3, 2)])
def test_against_every_term_of_every_pair(spark, monkeypatch, sizes):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", sizes[0])
    monkeypatch.setattr(divergence, "TILE_SOURCES", sizes[1])
    rows = some_rows()
    assert got(spark, rows) == plain(rows)


def test_repeated_rows_and_long_texts(spark):
    rows = [("abc " * 40_000 + "def", "en", "a")] * 10 + [("def ghi " * 3, "en", "b")] * 12
    assert got(spark, rows, min_docs=10, top_terms=1) == plain(rows, 10, 1)


def test_tasks_that_send_before_their_end(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD_ROWS", 8)
    rows = some_rows()
    assert got(spark, rows, min_docs=3) == plain(rows, 3)


def test_shares_of_large_counts():
    counts = np.array([0, 1, 10**12, 8 * 10**15], np.int64)
    n, v = int(counts.sum()), 5
    assert divergence._shares(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in counts]


def test_galloping_finds_what_both_hold():
    a, b = np.array([1, 5, 9]), np.arange(0, 100, 3)
    in_a, in_b = divergence._gallop(a, b)
    assert a[in_a].tolist() == b[in_b].tolist() == [9]
    assert divergence._gallop(a, np.zeros(0, np.int64))[0].tolist() == []
