"""Exact top-k search by tiled matrix products.

Vectors are turned into whole numbers, packed once into small blocks of one
dimension and the narrowest kind of number, and written. Shards of candidates
meet groups of queries in a grid of cells: a task holds the queries of its cell
with their k best and reads the candidates past them, a matrix product per tile.
The lists of the shards are cut again before the shuffle and merged per query.
What a task holds is bounded by the group, and copies follow the grid, not the
number of shuffle partitions.

Cases: vectors that are null, empty, or hold null or non-finite components, and
rows without an id take no part. Rows of one id count once, with the smallest
vector. Vectors of another dimension than the query's are no candidates. Ties
go to the smaller id. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import written
from itemspark.session import ship
from itemspark.skew import top_rows

ship(__name__)

#: A tile: queries by candidates.
QUERY_ROWS = 1024
BLOCK_ROWS = 1024
#: Bytes of a packed block; a batch to a Python worker has 10,000 blocks at most.
BLOCK_BYTES = 4096
#: Numbers in the queries of a cell, which its task holds.
GROUP_NUMBERS = 2**23
#: Products of a cell, where there are cells enough for all cores.
CELL_PRODUCTS = 2**35
_BLOCK = "dim int, n int, asked boolean, kind string, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"
#: Whole numbers below these are exact in floating point of four and eight bytes.
_EXACT = {"<f4": 2.0**24, "<f8": 2.0**53}
_MARGIN = 1 + 1e-6
_NONE = np.iinfo("i8")


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The same values in the narrowest kind of number that holds them."""
    top = np.abs(matrix).max(initial=0)
    for kind in ("<i1", "<i2", "<i4"):
        if top <= np.iinfo(kind).max and np.array_equal(small := matrix.astype(kind), matrix):
            return small
    return matrix.astype("<f8")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, asked) as blocks of candidates, and the asked ones again as blocks of queries."""
    for batch in batches:
        ids, asked = batch["id"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False)
        ends = batch["v"].offsets.to_numpy()
        values, starts, dims = batch["v"].flatten().to_numpy(zero_copy_only=False), ends[:-1] - ends[0], np.diff(ends)
        out: dict[str, list] = {name.split()[0]: [] for name in _BLOCK.split(", ")}
        for dim in np.unique(dims):
            for is_asked, chosen in ((False, dims == dim), (True, (dims == dim) & asked)):
                rows = np.nonzero(chosen)[0]
                matrix = _narrow(values[starts[rows, None] + np.arange(dim)])
                step = max(1, BLOCK_BYTES // (int(dim) * matrix.itemsize))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    block = (int(dim), len(part), is_asked, matrix.dtype.str, ids[part].astype("<i8").tobytes(), matrix[at : at + step].tobytes())
                    for column, value in zip(out.values(), block, strict=True):
                        column.append(value)
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out.values(), kinds, strict=True)], names=list(out))


def _longest(matrix: np.ndarray) -> float:
    """At least the length of the longest row."""
    wide = matrix.astype("<f8", copy=False)
    with np.errstate(over="ignore"):
        return float(np.sqrt(np.einsum("ij,ij->i", wide, wide).max(initial=0))) * _MARGIN


def _marked(marks: np.ndarray) -> np.ndarray:
    """Where a table of marks is set, row after row; eight empty places are passed over at a time."""
    marks = marks.ravel()
    if len(marks) % 8:
        return np.flatnonzero(marks)
    eights = marks.reshape(-1, 8)
    some = np.flatnonzero(marks.view("u8"))
    at, place = np.nonzero(eights[some])
    return some[at] * 8 + place


class _Search:
    """The k best of the candidates that came past, for the queries of one dimension."""

    def __init__(self, dim: int, k: int) -> None:
        self.dim, self.k, self.asked, self.waiting, self.n_waiting, self.room = dim, k, [], [], 0, {}
        self.ids: np.ndarray | None = None

    def ask(self, kind: str, ids: bytes, vectors: bytes) -> None:
        self.asked.append((np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(-1, self.dim)))

    def offer(self, kind: str, ids: bytes, vectors: bytes) -> None:
        if not self.asked and self.ids is None:
            return
        self.waiting.append((np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(-1, self.dim)))
        self.n_waiting += len(self.waiting[-1][0])
        if self.n_waiting >= BLOCK_ROWS:
            self._meet()

    def _begin(self) -> None:
        """Queries come before candidates."""
        self.ids = np.concatenate([ids for ids, _ in self.asked])
        fits = all(part.dtype.kind == "i" and np.abs(part.astype("<f8")).max(initial=0) < _EXACT["<f4"] for _, part in self.asked)
        self.queries = np.concatenate([part.astype("<f4" if fits else "<f8") for _, part in self.asked])
        self.asked = []
        self.longest = [_longest(self.queries[at : at + QUERY_ROWS]) for at in range(0, len(self.ids), QUERY_ROWS)]
        shape = (len(self.ids), self.k)
        self.best, self.best_ids, self.have = np.full(shape, _NONE.min), np.full(shape, _NONE.max), np.zeros(len(self.ids), "i8")

    def _meet(self) -> None:
        """The waiting candidates with every query, tile by tile."""
        if self.ids is None:
            self._begin()
        ids = np.concatenate([ids for ids, _ in self.waiting])
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.concatenate([part.astype("<f8") for _, part in self.waiting])[order]
        self.waiting, self.n_waiting = [], 0
        longest, kinds = _longest(vectors), {}
        for i, own in enumerate(self.longest):
            kind = next((kind for kind, most in _EXACT.items() if max(own * longest, own, longest) < most), "O")
            if kind not in kinds:
                kinds[kind] = vectors.astype(kind) if kind != "O" else np.frompyfunc(int, 1, 1)(vectors)
            self._tile(i * QUERY_ROWS, ids, kinds[kind], kind)

    def _products(self, first: int, c: np.ndarray, kind: str) -> np.ndarray:
        """Exact inner products: every partial sum is below what ``kind`` holds exactly, or whole numbers of any size."""
        q = self.queries[first : first + QUERY_ROWS]
        if kind == "O":
            return np.frompyfunc(int, 1, 1)(q) @ c.T
        if kind not in self.room or self.room[kind].size < QUERY_ROWS * len(c):
            self.room[kind] = np.empty(QUERY_ROWS * len(c), kind)
        return np.matmul(q.astype(kind, copy=False), c.T, out=self.room[kind][: len(q) * len(c)].reshape(len(q), len(c)))

    def _tile(self, first: int, ids: np.ndarray, c: np.ndarray, kind: str) -> None:
        scores = self._products(first, c, kind)
        rows = np.arange(len(scores))
        if kind == "O":
            return self._sorted_out(first, rows, ids, scores)
        # the last of a full list; a candidate below it cannot enter
        full = self.have[first : first + len(scores)] == self.k
        last = np.where(full, self.best[first : first + len(scores), -1], -np.inf).astype(kind)
        rows = rows[scores.max(axis=1) >= last]
        if not len(rows):
            return
        some = scores[rows]
        enter = some >= last[rows, None]
        if np.count_nonzero(enter) > 4 * len(rows) * (self.k + 8):
            return self._sorted_out(first, rows, ids, some)
        at, column = np.divmod(_marked(enter), len(ids))
        n = np.bincount(at, minlength=len(rows))
        if (many := n > self.k + 8).any():
            self._sorted_out(first, rows[many], ids, some[many])
            few = ~many[at]
            at, column, n = at[few], column[few], np.where(many, 0, n)
        if not len(at):
            return
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        found, found_ids = np.full((len(rows), n.max()), _NONE.min), np.full((len(rows), n.max()), _NONE.max)
        other = ids[column] != self.ids[first + rows[at]]
        at, column, place = at[other], column[other], place[other]
        found[at, place], found_ids[at, place] = some[at, column].astype("i8"), ids[column]
        self._merge(first + rows, found, found_ids, np.bincount(at, minlength=len(rows)))

    def _sorted_out(self, first: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The k best of a whole row: candidates are in the order of their ids, the first of equals is the smallest id."""
        if not len(rows):
            return
        asked, every = self.ids[first + rows], np.arange(len(rows))
        at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        own = ids[at] == asked
        scores[every[own], at[own]] = -np.inf
        free = len(ids) - own.astype("i8")
        shape = (len(rows), min(self.k, len(ids)))
        found, found_ids = np.full(shape, _NONE.min), np.full(shape, _NONE.max)
        for rank in range(shape[1]):
            best, left = np.argmax(scores, axis=1), free > rank
            found[left, rank], found_ids[left, rank] = scores[every, best][left].astype("i8"), ids[best[left]]
            scores[every, best] = -np.inf
        self._merge(first + rows, found, found_ids, np.minimum(free, shape[1]))

    def _merge(self, rows: np.ndarray, found: np.ndarray, found_ids: np.ndarray, n: np.ndarray) -> None:
        scores, ids = np.hstack([self.best[rows], found]), np.hstack([self.best_ids[rows], found_ids])
        order = np.lexsort((ids, ~scores), axis=1)[:, : self.k]  # ~ turns the order round and does not overflow
        self.best[rows], self.best_ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        self.have[rows] = np.minimum(self.have[rows] + n, self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self._meet()
        for at in range(0, 0 if self.ids is None else len(self.ids), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            there = np.arange(self.k) < self.have[part, None]
            columns = [np.repeat(self.ids[part], self.have[part]), self.best_ids[part][there], self.best[part][there]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])


def _cells(k: int):
    """Blocks sorted by cell and dimension, queries first, to the k best of each query in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None
        for batch in batches:
            for cell, dim, asked, *block in zip(*(batch[name].to_pylist() for name in ("cell", "dim", "asked", "kind", "ids", "vectors")), strict=True):
                if (cell, dim) != now:
                    if search:
                        yield from search.found()
                    now, search = (cell, dim), _Search(dim, k)
                (search.ask if asked else search.offer)(*block)
        if search:
            yield from search.found()

    return run


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``v`` = floor(scale * x) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), odd.alias("odd"))
    fit = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.col("odd"))
    once = fit.groupBy("id").agg(F.min("v").alias("v"))
    # the floor of a double as a double: a cast to long could overflow
    return once.select("id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` over whole vectors (``id``, ``v``).

    ``is_query`` selects the queries among them by ``id``.
    """
    spark = vectors.sparkSession
    asked = F.coalesce(is_query, F.lit(False)).alias("asked")
    blocks = written(vectors.select("id", "v", asked).mapInArrow(_pack, _BLOCK), "vectors")
    sizes = {r.asked: r for r in blocks.groupBy("asked").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("long") * F.col("dim")).alias("numbers")).collect()}
    n, n_asked, numbers = sizes[False].n if False in sizes else 0, sizes[True].n if True in sizes else 0, sizes[True].numbers if True in sizes else 0
    groups = max(1, -(-numbers // GROUP_NUMBERS))
    cells = max(4 * spark.sparkContext.defaultParallelism, -(-n * n_asked // CELL_PRODUCTS))
    shards = max(1, min(-(-cells // groups), -(-n // BLOCK_ROWS)))
    of = lambda parts, seed: F.pmod(F.xxhash64("ids", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = blocks.filter(~F.col("asked")).select("*", of(shards, 0).alias("shard"), every(groups).alias("group"))
    queries = blocks.filter("asked").select("*", of(groups, 1).alias("group"), every(shards).alias("shard"))
    dealt = candidates.unionByName(queries).withColumn("cell", F.col("shard") * groups + F.col("group")).drop("shard", "group", "n")
    ordered = dealt.repartitionById(shards * groups, "cell").sortWithinPartitions("cell", "dim", F.col("asked").desc())
    partial = ordered.mapInArrow(_cells(k), _FOUND)
    best = top_rows(partial, ["query_id"], ["-score", "vec_id"], k, out="rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
