"""Dropping lines that many documents share.

Two Bloom filters over line hashes (seen once, seen twice) tell which lines may
repeat; only those leave their task, as a 128-bit key with document and place.
Keys of enough documents are confirmed exactly and stay in the largest document
that holds them.

Cases: null or empty text is one empty line and is never dropped; a null
``doc_id`` is no document of its own, so its copies of frequent lines go;
repeated rows of an id are one document for counting, and each row loses only
lines of its own text; an empty table gives an empty one. Other columns pass
through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.llm.arrays import TwiceFilter, is_space, lower_ascii, span_hashes, stretches, twice_seen
from itemspark.llm.common import free_names, spread_join, with_text
from itemspark.session import durable, ship

ship(__name__)


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Of the lines whose key is long enough: text row, line number, start and end of the key; and the lower-cased bytes."""
    low = lower_ascii(data)
    breaks = np.nonzero(low == 10)[0]
    starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    starts = starts[starts < len(low)]
    ends = np.concatenate((starts[1:], [len(low)]))  # the break itself is stripped below
    row = np.searchsorted(offsets, starts, side="right") - 1
    solid = np.nonzero(~is_space(low))[0]
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    starts, ends, row = starts[full], ends[full], row[full]
    first, last = solid[a[full]], solid[b[full] - 1] + 1
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[row])
    points = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))
    long = points[last] - points[first] >= min_chars
    return row[long], line[long], first[long], last[long], low


def _hashes(min_chars: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in stretches(batch.column("text")):
            _, _, first, last, low = _keys(data, offsets, min_chars)
            yield span_hashes(low, first, last)

    return run


def _suspects(min_chars: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = TwiceFilter(*seen.value)
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("t")
            for at, _, data, offsets in stretches(batch.column("text")):
                row, line, first, last, low = _keys(data, offsets, min_chars)
                some = filtered.holds(span_hashes(low, first, last))
                raw = low.tobytes()
                key = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first[some], last[some], strict=True))
                pair = np.frombuffer(key, "<i8").reshape(-1, 2)
                rows = pa.array(at + row[some])
                columns = [ids.take(rows), hashes.take(rows), pa.array(line[some], pa.int32()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "line", "k1", "k2"])

    return run


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_to_drop(docs: DataFrame, min_chars: int, min_docs: int, bits: int = 1 << 27) -> DataFrame:
    """``doc_id``, ``t`` (hash of the text) and the numbers of its lines that go (from 0)."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", _text_hash(F.col("text")).alias("t"))
    seen = spark.sparkContext.broadcast(twice_seen(texts, ["text"], _hashes(min_chars), bits).parts())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    suspects = durable(texts.mapInArrow(_suspects(min_chars, seen), f"doc_id {id_type}, t long, line int, k1 long, k2 long"))
    per_doc = suspects.filter("doc_id IS NOT NULL").select("k1", "k2", "doc_id").distinct()
    frequent = per_doc.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    gone = spread_join(suspects, durable(frequent.filter(F.col("n") >= min_docs)), {"k1": "_k1", "k2": "_k2"}, "n")
    gone = gone.filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
    return gone.groupBy("doc_id", "t").agg(F.collect_set("line").alias("lines"))


def without(text: Column, gone: Column) -> Column:
    """A text without the lines of these numbers."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(F.sort_array(left), lambda i: F.get(lines, i)), "\n")


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """The documents with the numbers of lines that are dropped (null where none is), and that column's name."""
    own_id, own_hash, lines = free_names(docs, "id", "t", "gone")
    gone = lines_to_drop(docs, min_chars, min_docs).select(F.col("doc_id").alias(own_id), F.col("t").alias(own_hash), F.col("lines").alias(lines))
    # the hash tells apart the texts of null ids and of repeated ones
    same = docs["doc_id"].eqNullSafe(gone[own_id]) & (_text_hash(docs["text"]) == gone[own_hash])
    return docs.join(gone, same, "left").drop(own_id, own_hash), lines


def dedup_documents(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents without those lines; same columns."""
    marked, gone = _marked(docs, min_chars, min_docs)
    return with_text(marked, F.when(F.col(gone).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(gone)))).drop(gone)


def line_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    marked, gone = _marked(docs.select("doc_id", "text"), min_chars, min_docs)
    text = F.coalesce("text", F.lit(""))
    kept = F.when(F.col(gone).isNull(), text).otherwise(without(text, F.col(gone)))
    return marked.select(
        "doc_id",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
