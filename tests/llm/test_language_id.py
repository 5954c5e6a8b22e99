"""Nearest centroids: held-out accuracy, a plain count of n-grams, rejection, and hard rows."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from itemspark.llm import language_id
from itemspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, held_out string, score int, rejected int"


def plain_counts(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(words) + " " if words else ""
    return Counter(padded[k : k + n] for n in language_id.GRAMS for k in range(len(padded) - n + 1) if padded[k : k + n] != " ")


def feature(gram):
    points = np.array([ord(c) for c in gram], np.uint32)
    found = [f for at, f in language_id._grams(points, np.zeros(len(points), np.int64)) if len(f) == 1 and len(at) == 1]
    return int(found[-1][0])


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_counts_are_those_of_a_plain_version(monkeypatch, piece):
    monkeypatch.setattr(language_id, "_PIECE", piece)
    texts = ["The  cat's\n42 HATS", "", "123 !?", "É", "ein Wort. " * 30, "漢字 かな", "x" * 120]
    counted = language_id.counts_of([language_id.words_only(t) for t in texts])
    for text, row in zip(texts, counted, strict=True):
        want = np.zeros(language_id.FEATURES)
        for gram, n in plain_counts(text).items():
            want[feature(gram)] += n
        assert row.tolist() == want.tolist(), text


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_language_id"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    assert all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 40 and sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.95 * len(out)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op13_language_id"](spark, SMALL).collect()))


def rows_of(words, n, lang, first):
    draw = np.random.default_rng(first)
    return [(first + k, " ".join(draw.choice(words, 30)), lang) for k in range(n)]


def test_hard_rows(spark):
    rows = rows_of(["alpha", "beta", "gamma"], 30, "aa", 0) + rows_of(["xyzzy", "quux", "wibble"], 20, "bb", 100)
    odd = [(200, None, "aa"), (201, "", "bb"), (202, "12 34 !", "aa"), (203, "漢字", None), (204, "quux " * 50_000, None), (None, "alpha beta", None), (100, rows[30][1], "bb"), (205, "wibble", None)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + odd], SCHEMA).repartition(4)
    got = language_id.identify(frame).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by_id[203].lang_pred == "aa" and by_id[203].rejected and by_id[203].score == 0  # nothing shared: a guess
    assert by_id[204].lang_pred == "bb" and by_id[205].lang_pred == "bb" and by_id[None].lang_pred == "aa"
    assert by_id[None].held_out is False
    assert all(r.lang_pred == ("aa" if r.doc_id < 100 else "bb") for r in got if r.doc_id is not None and r.doc_id < 200)


def test_held_out_rows_and_labels_are_never_read(spark):
    rows = rows_of(["alpha", "beta"], 40, "aa", 0) + rows_of(["quux", "xyzzy"], 40, "bb", 100)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else g) for i, t, g in rows]
    frames = [spark.createDataFrame([(*r, "x", 1, 2) for r in x], SCHEMA) for x in (rows, changed)]
    a, b = (sorted(map(tuple, language_id.identify(f).collect())) for f in frames)
    assert a == b


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "some words", None, "x", 1, 2), (2, None, None, "x", 1, 2)], SCHEMA)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(frame).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]


def test_far_texts_are_rejected(spark):
    rows = rows_of(["alpha", "beta", "gamma"], 60, "aa", 0)
    frame = spark.createDataFrame([*((*r, "x", 1, 2) for r in rows), (7000, "zzyzx alphorn", None, "x", 1, 2)], SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    assert got[7000].rejected and got[7000].lang_pred == "aa" and got[7000].score == 0
    assert sum(r.rejected for r in got.values()) < 10


def test_several_centroids_keep_unlike_groups_apart():
    rows = np.zeros((40, language_id.FEATURES), np.float32)
    rows[:20, 5], rows[20:, 9] = 1, 1
    centers, size, far = language_id.cluster(rows, 4)
    assert sorted(size.tolist()) == [20, 20] and far.max() < 1e-6
    assert sorted(np.argmax(centers, axis=1).tolist()) == [5, 9]
