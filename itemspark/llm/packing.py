"""Best-fit packing of tokenized documents into sequences of one length.

Best-fit decreasing only looks at lengths, of which there are as many as a
sequence has places. So the driver packs the histogram of lengths: all pieces of
a length that meet bins of one remaining capacity are placed by one step, with a
segment tree over capacities that finds the tightest open bin in logarithmic
time. The steps say where the r-th piece of a length goes; ranks are numbered in
buckets and joined with the steps. The result is that of placing every piece of
the whole corpus one by one, longest first.

Cases: a null or empty text has its end mark as only id; longer documents are
cut into full pieces, the last may be shorter; repeated rows are packed as often
as they occur; an empty table gives no rows. Extra columns are not read. Equal
lengths are placed in the order of bucket, id and piece.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemspark.llm.arrays import is_space, lower_ascii, span_hashes, stretches
from itemspark.session import durable, ship

ship(__name__)

END_ID = 0
_BUCKET_ROWS = 5_000
_KNOWN_WORDS = 600_000


class _Words:
    """Ids of words already seen by this worker, by hash; begins anew when it has grown too large."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def rows(self, hashes: np.ndarray, word) -> np.ndarray:
        """Places of these distinct sorted hashes in the table; ``word(i)`` gives the text of the i-th."""
        if len(self.hashes) > _KNOWN_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        fresh = np.nonzero(~known)[0]
        if len(fresh):
            found = [e.ids for e in self.tokenizer.encode_batch([word(i) for i in fresh], add_special_tokens=False)]
            first = len(self.starts) - 1
            ends = np.cumsum([len(x) for x in found], dtype=np.int64) + self.starts[-1]
            self.starts = np.concatenate((self.starts, ends))
            self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], "<u4")))
            every = np.concatenate((self.hashes, hashes[fresh]))
            index = np.concatenate((self.index, np.arange(first, first + len(fresh))))
            order = np.argsort(every, kind="stable")
            self.hashes, self.index = every[order], index[order]
            at = np.searchsorted(self.hashes, hashes)
        return self.index[at]


def _worker_words(path: str) -> _Words:
    """One table per worker process, also from task to task."""
    state = sys.modules.setdefault("_itemspark_words", types.ModuleType("_itemspark_words"))
    if getattr(state, "path", None) != path:
        state.path, state.words = path, _Words(path)
    return state.words


def _units(data: np.ndarray, offsets: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the tokenizer never joins: words, and within them letters and marks of ASCII.

    ``plain`` leaves words whole, for texts that may hold control strings. The
    apostrophe stays with its neighbours since contractions begin with it.
    """
    space = is_space(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    if len(data):
        edge = space[1:] != space[:-1]
        if not plain:
            folded = data | 32
            letter = (folded >= 97) & (folded <= 122)
            mark = (data < 128) & ~letter & ~space & (data != 39)
            edge |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        cut[1:-1] |= edge
    bounds = np.nonzero(cut)[0]
    starts, ends = bounds[:-1], bounds[1:]
    solid = ~space[starts] if len(starts) else np.zeros(0, bool)
    return starts[solid], ends[solid]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def token_ids(words: _Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a stretch, and the place where each text's ids begin (one more entry than texts)."""
    raw = data.tobytes()
    plain = b"<|" in raw
    low = data if plain else lower_ascii(data)
    starts, ends = _units(low, offsets, plain)
    raw = raw if plain else low.tobytes()
    hashes, first, back = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    rows = words.rows(hashes, lambda i: raw[starts[first[i]] : ends[first[i]]].decode("utf-8"))[back]
    sizes = words.starts[rows + 1] - words.starts[rows]
    ids = words.ids[_ragged(words.starts[rows], sizes)]
    before = np.concatenate(([0], np.cumsum(sizes)))
    return ids, before[np.searchsorted(starts, offsets)]


def _pieces(path: str, places: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(path)
        for batch in batches:
            for at, end, data, offsets in stretches(batch.column("text")):
                ids, first = token_ids(words, data, offsets)
                out = []
                for row in range(end - at):
                    whole = np.append(ids[first[row] : first[row + 1]], END_ID).astype("<u4")
                    for k, start in enumerate(range(0, len(whole), places)):
                        piece = whole[start : start + places].tobytes()
                        out.append((at + row, k, start, len(piece) // 4, zlib.crc32(piece), piece))
                columns = list(zip(*out, strict=True))
                arrays = [batch.column("doc_id").take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(columns[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def tokenize(docs: DataFrame, tokenizer_path: str, places: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``ids`` holds little-endian 32-bit ids where asked for."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, places, with_ids), schema)


class _OpenBins:
    """Open bins by remaining capacity: ranges of bin numbers, and a segment tree that tells where there are any."""

    def __init__(self, places: int):
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(places + 1)]
        self.width = 1 << places.bit_length()
        self.any = [False] * (2 * self.width)

    def _mark(self, capacity: int) -> None:
        i = capacity + self.width
        self.any[i] = bool(self.ranges[capacity])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def push(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.ranges[capacity].append((first, n))
            self._mark(capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        taken = self.ranges[capacity].pop()
        self._mark(capacity)
        return taken

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` with an open bin."""
        i = length + self.width
        if self.any[i]:
            return length
        while i > 1:  # up to the first right neighbour that holds any, then down its left side
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_steps(histogram: dict[int, int], places: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, end rank, first bin, pieces per bin, offset) of best-fit decreasing.

    Every length ends one step and every other step empties a range of bins, whose
    capacity it at least halves: the steps are bounded by the lengths alone.
    """
    bins, next_bin, steps = _OpenBins(places), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity, first, n = places, next_bin, -(-left // (places // length))
                next_bin += n
            else:
                first, n = bins.pop(capacity)
            each = capacity // length
            whole = min(n, left // each)
            if whole:
                steps.append((length, rank, rank + whole * each, first, each, places - capacity))
                bins.push(capacity - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:
                steps.append((length, rank, rank + left, first + whole, left, places - capacity))
                bins.push(capacity - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            bins.push(capacity, first + whole, n - whole)
    return steps


def pack(pieces: DataFrame, places: int = 2048) -> DataFrame:
    """Pieces (a stored table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as a sequence has places
    steps = best_fit_steps({r["length"]: r["n"] for r in counted}, places)
    plan = spark.createDataFrame(steps, "_length long, _lo long, _hi long, _bin long, _each long, _offset long")
    buckets = max(1, -(-sum(r["n"] for r in counted) // _BUCKET_ROWS))
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = bucketed.withColumn("_r", inside).join(firsts, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_r"))
    # bounded by the places of a sequence, see best_fit_steps
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    j = F.col("_rank") - F.col("_lo")
    return placed.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(j / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (j % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, places: int = 2048) -> DataFrame:
    return pack(durable(tokenize(docs, tokenizer_path, places)), places)
