"""Skew helpers agree with a plain window when one key owns most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemspark import skew


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(6000).select(key.alias("k"), (F.col("id") * 7919 % 6000).alias("ordinal"), F.round(F.rand(5) * 3).alias("score")).cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("order", [["ordinal"], ["-score", "ordinal"]])
@pytest.mark.parametrize("up_to", [None, 1500])
def test_position_in_group(hot, order, up_to):
    plain = hot.withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy(*skew.ordering(order))).cast("long"))
    plain = plain if up_to is None else plain.filter(F.col("pos") <= up_to)
    assert rows(skew.position_in_group(hot, ["k"], order, up_to=up_to), "k", "ordinal", "pos") == rows(plain, "k", "ordinal", "pos")


@pytest.mark.parametrize("order", [["-a", "id"], ["a", "-b", "id"]])
def test_position_by_columns_of_many_values(spark, order):
    made = spark.range(20000).select("id", (F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7919 % 5000).alias("a"), (F.col("id") * 31 % 777).alias("b"))
    plain = made.withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy(*skew.ordering(order))).cast("long"))
    assert rows(skew.position_in_group(made, ["k"], order), "id", "pos") == rows(plain, "id", "pos")


def test_position_slices_split_a_hot_key(hot):
    plan = skew.position_in_group(hot, ["k"], ["ordinal"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_s0" in plan and "Window" in plan


def test_dense_number(hot):
    plain = hot.withColumn("n", F.row_number().over(W.orderBy(F.desc("score"), "ordinal")).cast("long") - 1)
    assert rows(skew.dense_number(hot, ["-score", "ordinal"], "n"), "ordinal", "n") == rows(plain, "ordinal", "n")


def test_salted_lookup(hot):
    dim = hot.groupBy("k").agg(F.max("ordinal").alias("top"))
    got = skew.salted_lookup(hot, dim, ["k"], salt_on="ordinal")
    assert rows(got, "k", "ordinal", "top") == rows(hot.join(dim, "k"), "k", "ordinal", "top")


def test_rate_limit_frames_cross_the_hour(spark):
    from itemspark.operators import ranks

    seconds = [3590, 3595, 3605, 3640, 7200, 7259, 7260]
    ev = spark.createDataFrame([(s,) for s in seconds], "s long").select(
        F.lit("a").alias("key"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s)").alias("ts"), "s"
    )
    got = {r.s: r.n_recent for r in ranks.rate_limit_alerts(ev, ["key"]).collect()}
    want = {s: sum(1 for o in seconds if s - 60 <= o <= s) for s in seconds}
    assert got == {s: n for s, n in want.items() if n >= 3}
