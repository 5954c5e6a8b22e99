"""Rows that are numbered are worked out once, and rows that are whole are not validated again for repair."""

import pytest
from pyspark.sql import functions as F

from itemspark import skew
from itemspark.operators import mend, validate
from test_items import SCHEMA, blank, item


def test_numbering_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def looked_at(x):
        seen.add(1)
        return x

    rows = spark.range(0, 300, 1, 4).select((F.col("id") * 7 % 300).alias("k"), looked_at("id").alias("v"))
    got = skew.dense_number(rows, ["k"], "n").collect()
    assert sorted((r.k, r.n, r.v * 7 % 300) for r in got) == [(k, k, k) for k in range(300)]
    assert seen.value == 300


def test_skipped_rows_are_not_validated(spark):
    rows = spark.createDataFrame([{**item(answer="E"), "ordinal": 0}, {**item(answer="E"), "ordinal": 1}], SCHEMA)
    got = validate.validate_schema(rows, skip=F.col("ordinal") == 0).select("ordinal", "reject_reason").collect()
    assert {r.ordinal: r.reject_reason for r in got} == {0: None, 1: "answer_letter"}


@pytest.mark.parametrize("flag,issues", [(True, []), (False, ["untouched"]), (None, [])])
def test_repair_touches_flagged_rows_and_those_without_a_flag(spark, flag, issues):
    rows = spark.createDataFrame([{**blank(), "ordinal": 0}], SCHEMA).withColumn("todo", F.lit(flag).cast("boolean"))
    assert mend.repair_aggressively(rows, "todo").first().issues == issues
