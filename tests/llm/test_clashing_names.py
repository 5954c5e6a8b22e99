"""Stages pass other columns through, whatever their names are; rows without an id of their own are told apart."""

from __future__ import annotations

import pytest
from hard_rows import prose

from itemspark.llm import line_dedup, mixing, near_duplicates, quality

CLASHING = ["quality", "_quality", "id", "_id", "t", "_t", "gone", "_gone", "row", "copy", "place", "key", "_k", "number", "_n", "size", "_size", "epochs", "taken", "_words", "known"]
SCHEMA = "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{c}` int" for c in CLASHING)
LINE = "This very line stands in a great many of the documents"


def frame(spark, ids):
    texts = ["\n".join(f"Here {prose(100 * k + j, 9)}." for j in range(12)) + f"\n{LINE}." for k in range(len(ids))]
    return spark.createDataFrame([(i, t, "web", 1, *range(len(CLASHING))) for i, t in zip(ids, texts, strict=True)], SCHEMA)


STAGES = [quality.clean_documents, line_dedup.dedup_documents, near_duplicates.one_of_each, mixing.mixed_documents]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_other_columns_pass(spark, stage):
    docs = frame(spark, range(8))
    out = stage(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(range(8))
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rows)


def test_rows_without_an_id_of_their_own(spark):
    docs = frame(spark, [1, 2, 2, None, None, 9, (1 << 62) + 5])
    again = docs.filter("doc_id = 1").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[f"`{c}`" for c in docs.columns[1:]])
    out = near_duplicates.one_of_each(docs.unionByName(again))
    assert out.columns == docs.columns
    # the copy of row 1 goes, and the row that keeps its id stays; all others are different texts
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i in [1, 2, 2, None, None, 9, (1 << 62) + 5])
