"""Rows whose ids are null or repeated are documents of their own."""

from __future__ import annotations

from hard_rows import prose

from itemspark.llm import line_dedup, near_duplicates

LINE = "This very line stands in a great many of the documents"


def test_shared_lines_of_null_and_repeated_ids(spark):
    rows = [(k, LINE) for k in range(1, 7)]
    rows += [(None, f"{LINE}\nfirst null"), (None, "clean line of a null id\nsecond line"), (3, "another text of the id\nits second line"), (None, None)]
    got = line_dedup.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(k, "") for k in range(1, 6)] + [(6, LINE), (None, "first null"), (None, "clean line of a null id\nsecond line"), (3, "another text of the id\nits second line"), (None, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(None, a), (None, a), (5, b), (5, b), (None, b), (7, c), (7, prose(4, 60)), (2, c), (None, "short"), (None, None), (9, "short")]
    got = near_duplicates.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(None, a), (5, b), (2, c), (7, prose(4, 60)), (None, None), (9, "short")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
