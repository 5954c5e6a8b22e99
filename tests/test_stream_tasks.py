"""A text table that comes as one row group is dealt to tasks by its size."""

import glob

from itemspark.catalog.streaming import StreamData
from itemspark.streaming import streams


def test_rows_are_dealt_by_size(spark, tmp_path):
    spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(md5(string(id)), 3) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def tasks(stream, name):
        seen = []
        streams.start(stream, lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count())), f"{tmp_path}/{name}").awaitTermination()
        return seen

    cores = spark.sparkContext.defaultParallelism
    assert tasks(StreamData(spark, str(tmp_path)).table("documents"), "a") == [(cores, 4000)]
    rows = streams.read_table_stream(spark, f"{tmp_path}/documents.parquet", spark.read.parquet(f"{tmp_path}/documents.parquet").schema)
    assert tasks(streams.dealt(rows, 30_000, 1000), "b") == [(30, 4000)]
