"""Regions of the Jaccard join: what goes on to them, and large ones that must be divided."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from itemspark.llm import near_duplicates
from itemspark.llm.arrays import shingle_sets

WORDS = [f"w{i}" for i in range(400)]


def changed(draw, words, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = draw.choice(WORDS)
    return out


def sets_of(texts, width):
    raw = [t.encode() for t in texts]
    return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), width)


@pytest.mark.parametrize("percent", [85, 80, 50])
@pytest.mark.parametrize("block", [256, 3])
def test_links_of_a_region(monkeypatch, percent, block):
    monkeypatch.setattr(near_duplicates, "_BLOCK", block)
    draw = random.Random(percent)
    texts = []
    for _ in range(20):
        base = [draw.choice(WORDS) for _ in range(draw.randrange(5, 150))]
        texts += [" ".join(changed(draw, base, draw.randrange(6))) for _ in range(draw.randrange(1, 20))]
    links = dict(near_duplicates._region_links(np.arange(len(texts)), sets_of(texts, 4), percent))
    assert {i: links.get(i, i) for i in range(len(texts))} == {i: c for i, (_, c) in brute.components(list(enumerate(texts)), 4, percent).items()}


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5)])
def test_linked_sets_share_as_many_parts_as_they_need(percent, width):
    draw = random.Random(7)
    seen = 0
    for _ in range(400):
        base = [draw.choice(WORDS) for _ in range(draw.randrange(1, 200))]
        pair = sets_of([" ".join(base), " ".join(changed(draw, base, draw.randrange(4)))], width)
        both = len(np.intersect1d(*pair))
        if not both or 100 * both < percent * (len(pair[0]) + len(pair[1]) - both):
            continue
        seen += 1
        signature, place, needs = near_duplicates._signatures(pair, percent)
        own = [set(signature[place == k].tolist()) for k in range(4)]
        # the place of the smaller set's next class is the larger one's own class where the classes differ
        assert any(len(own[a] & own[b]) >= max(needs[a], needs[b]) for a, b in ((0, 2), (1, 2), (0, 3)))
    assert seen > 100


def test_a_shared_passage_alone_goes_nowhere(spark):
    draw = random.Random(3)
    passage = [draw.choice(WORDS) for _ in range(80)]
    rows = [(k, " ".join([draw.choice(WORDS) for _ in range(300)] + passage)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {k: k for k, _ in rows}


def test_most_copies_of_a_family_go_to_one_region(spark):
    draw = random.Random(5)
    base = [draw.choice(WORDS) for _ in range(200)]
    texts = [" ".join(changed(draw, base, 1)) for _ in range(80)]
    sets = sets_of(texts, 5)
    signature, place, needs = near_duplicates._signatures(sets, 80)
    rows = []
    for k, s in enumerate(sets):
        lists = [sorted({int(x) for x in signature[place == 2 * k + step].view(np.int64)}) for step in (0, 1)]
        rows.append((k, len(s), lists[0], int(needs[2 * k]), lists[1], int(needs[2 * k + 1])))
    reps = spark.createDataFrame(rows, "rep long, n long, shared0 array<long>, need0 long, shared1 array<long>, need1 long")
    regions = near_duplicates.regions_of(reps)
    assert regions.select("rep").distinct().count() == 80 and regions.count() <= 2 * 80


def test_a_large_region_is_divided_by_spark(spark):
    """More sets than a task compares, with the given bounds: a family in which pivots link nearly all, and some that are near but not linked."""
    draw = random.Random(11)
    base = [draw.choice(WORDS) for _ in range(150)]
    n = near_duplicates.REGION_SETS + 300
    rows = [(k, " ".join(changed(draw, base, draw.randrange(1, 3)))) for k in range(n)]
    half = base[:120] + [f"own{k}" for k in range(60)]
    rows += [(n + k, " ".join(changed(draw, half, 1))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    regions = near_duplicates.regions_of
    sizes = []

    def watched(reps):
        out = regions(reps)
        sizes.append(out.groupBy("region").count().agg(F.max("count")).first()[0])
        return out

    near_duplicates.regions_of = watched
    try:
        got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    finally:
        near_duplicates.regions_of = regions
    assert sizes[0] > near_duplicates.REGION_SETS
    assert {got[k] for k in range(n)} == {0} and {got[n + k] for k in range(20)} == {n}
