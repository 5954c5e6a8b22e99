"""The pipeline on hard rows: each stage by what it must and must not change."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
from conftest import SMALL
from hard_rows import no_rows, tables  # noqa: F401
from tokenizers import Tokenizer


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, SMALL).cache()
    assert good.columns == docs.columns and 0 < good.count() < len(before)
    texts = {r.doc_id: r.text for r in good.collect()}
    lines = corpus_pipeline.drop_shared_lines(spark, good, SMALL).cache()
    wanted = brute.line_dedup(list(texts.items()))
    got = {r.doc_id: brute.sha((r.text or "").encode()) for r in lines.collect()}
    assert lines.columns == docs.columns and got == {i: v[2] for i, v in wanted.items()}
    apart = corpus_pipeline.near_copies(spark, lines, SMALL).cache()
    groups = brute.components([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    kept = [r.doc_id for r in apart.collect()]
    assert apart.columns == docs.columns and Counter(groups[i][1] for i in kept) == Counter({c for _, c in groups.values()})
    mixed = corpus_pipeline.mix_sources(spark, apart, SMALL).cache()
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= set(kept)
    packed = corpus_pipeline.pack_sequences(spark, mixed, SMALL)
    want = Counter()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in mixed.collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in packed.collect():
        have[r.doc_id] += r.length
    assert have == want


def test_run_on_hard_rows(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_run_on_nothing(spark, no_rows):
    assert corpus_pipeline.run(spark, no_rows).collect() == []
