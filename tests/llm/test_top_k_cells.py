"""Exact top-k: a grid of many cells gives what all pairs give, and what a task holds does not grow with the candidates."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemspark.llm import top_k


def all_pairs(rows, k):
    out = []
    for q, a in rows:
        if q % 7 == 0:
            found = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def search(spark, rows, k):
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    return sorted(map(tuple, top_k.exact_top_k(vectors, F.col("id") % 7 == 0, k).collect()))


@pytest.mark.parametrize("small", [True, False])
def test_every_kind_of_number_in_many_cells(spark, monkeypatch, small):
    if small:
        for name, value in (("QUERY_ROWS", 8), ("BLOCK_ROWS", 20), ("BLOCK_BYTES", 64), ("GROUP_NUMBERS", 60), ("CELL_PRODUCTS", 500)):
            monkeypatch.setattr(top_k, name, value)
    draw = random.Random(5)
    rows = [(i, [float(draw.randrange(-2, 3)) for _ in range(draw.choice([1, 3, 5]))]) for i in range(-20, 200)]  # many ties
    rows += [(i, [float(draw.randrange(-m, m)) for _ in range(4)]) for i, m in zip(range(200, 320), [100, 9_000, 2**20, 2**29] * 30, strict=True)]
    rows += [(320, [2.0**26, 1.0, 0.0]), (321, [2.0**27, -1.0, 0.0]), (322, [2.0**27, -1.0, 1.0])]  # beyond 2**53, one apart
    rows += [(329, [1.0] * 9), (330, [float(draw.randrange(9)) for _ in range(11)]), (343, [0.0] * 12), (344, [0.0] * 12)]
    for k in (1, 4, 40):
        assert search(spark, rows, k) == all_pairs(rows, k)


def test_equal_vectors_and_no_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000, 0, -1)]
    assert [r for r in search(spark, rows, 3) if r[0] in (7, 2996)] == [(7, 1, 1, 5), (7, 2, 2, 5), (7, 3, 3, 5), (2996, 1, 1, 5), (2996, 2, 2, 5), (2996, 3, 3, 5)]
    assert search(spark, [], 3) == [] and search(spark, [(1, [1.0])], 3) == [] and search(spark, [(7, [1.0])], 3) == []


def test_queries_are_not_joined_to_shards(spark):
    """The rows of a join's key are held together: all queries, for each shard."""
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "id long, v array<double>")
    plan = top_k.exact_top_k(vectors, F.col("id") % 7 == 0, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_task_does_not_hold_the_candidates():
    draw = np.random.default_rng(1)

    def blocks(n):
        for at in range(-1, n):
            ids = np.arange(at * 1000, at * 1000 + 1000, dtype="<i8")
            vectors = draw.integers(-99, 99, (1000, 16)).astype("<i1")
            columns = {"cell": [0], "dim": [16], "asked": [at < 0], "kind": ["<i1"], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]}
            yield pa.RecordBatch.from_pydict(columns)

    def peak(n):
        tracemalloc.start()
        assert sum(len(batch) for batch in top_k._cells(5)(blocks(n))) == 5000
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(120) < 1.2 * peak(10)
