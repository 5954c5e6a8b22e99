"""JSON files of one object or one array of objects, read in ranges of bytes.

A large array need not fit a task. Files are cut at closing braces, which Spark
can do in the middle of a file, and the cuts are read by splits:

1. Each split tells what it does to a reader's state: how many quotes it has
   (odd: inside and outside of strings change places) and how much deeper the
   brackets get, for either beginning. These few numbers add up along a file,
   which gives every split the state it begins in.
2. Each split then emits the objects it holds whole, and the pieces of objects
   that cross its ends.
3. Pieces, two per split at most, are put together by file.

An object whose text is no JSON, an object that the file ends in, and a file
that is neither object nor array are kept as rows with ``_parse_error``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark.session import durable, ship

ship(__name__)

_QUOTE, _ESCAPE, _OPEN, _CLOSE = 34, 92, 123, 125


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the number of quotes up to it that are not escaped, and the step in depth it would make outside of strings."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _ESCAPE, at, -1))
    before = np.concatenate(([-1], plain[:-1])) if len(data) else plain
    quotes = (data == _QUOTE) & ((at - 1 - before) % 2 == 0)
    deeper = np.isin(data, np.frombuffer(b"{[", np.uint8)).astype(np.int64) - np.isin(data, np.frombuffer(b"}]", np.uint8))
    return np.cumsum(quotes), deeper


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, np.ndarray | None]]:
    """(key, bytes) of stretches of rows of one key in the order they come; (key, None) where a key's rows end."""
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows + 1, bool)
        change[0] = change[-1] = True
        for c in columns:
            change[1:-1] |= c[1:] != c[:-1]
        cuts = np.nonzero(change)[0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield last, None
            last = key
            # the brace that the cut took away stands at the end of every piece
            pieces = batch.column("value").slice(a, b - a).to_pylist()
            yield key, np.frombuffer("".join(p + "}" for p in pieces).encode(), np.uint8)
    if last is not None:
        yield last, None


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: its bytes, quotes, change in depth if it begins outside or inside of a string, and first sign."""
    rows: list[tuple] = []
    size = quotes = first = 0
    depth = [0, 0]
    for key, data in _runs(batches, ["file", "block", "size"]):
        if data is None:
            rows.append((*key, size, quotes, *depth, first))
            size = quotes = first = 0
            depth = [0, 0]
            continue
        count, deeper = _signs(data)
        outside = (count + quotes) % 2 == 0
        depth = [depth[0] + int(deeper[outside].sum()), depth[1] + int(deeper[~outside].sum())]
        size, quotes = size + len(data), quotes + int(count[-1])
        if not first:
            seen = data[~np.isin(data, np.frombuffer(b" \t\r\n\xef\xbb\xbf", np.uint8))]
            first = int(seen[0]) if len(seen) else 0
    names = ["file", "block", "size", "bytes", "quotes", "outside", "inside", "first"]
    kinds = [pa.string(), *[pa.int64()] * 7]
    yield pa.RecordBatch.from_arrays([pa.array([r[i].item() if hasattr(r[i], "item") else r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of a split in order; ``kind`` tells whole ones from the pieces that cross its ends."""

    def sent(no: int, found: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([no] * len(found), pa.int64()), pa.array([i for i, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.string()), pa.array([t.decode("utf-8", "replace") for _, _, t in found], pa.string())],
            ["no", "index", "kind", "text"],
        )

    def read(key: tuple, parts: Iterator[np.ndarray]) -> Iterator[list[tuple[int, str, bytes]]]:
        _, quotes, depth, base, _ = key
        index, held, kind = 0, [], "head"
        is_open = depth > base
        for data in parts:
            count, deeper = _signs(data)
            outside = (count + quotes) % 2 == 0
            after = depth + np.cumsum(np.where(outside, deeper, 0))
            begins = np.nonzero(outside & (data == _OPEN) & (after == base + 1))[0]
            ends = np.nonzero(outside & (data == _CLOSE) & (after == base))[0]
            raw, at, found = data.tobytes(), 0, []
            marks = sorted([(int(b), True) for b in begins] + [(int(e), False) for e in ends])
            for place, is_begin in marks:
                if is_begin:
                    is_open, held, at, kind = True, [], place, "whole"
                elif is_open:
                    found.append((index, kind, b"".join([*held, raw[at : place + 1]])))
                    is_open, held, index = False, [], index + 1
            if is_open:
                held.append(raw[at:])
            quotes, depth = (quotes + int(count[-1])) % 2, int(after[-1])
            yield found
        if is_open:
            yield [(index, "tail" if kind == "whole" else "middle", b"".join(held))]

    def without_last(runs: Iterator, key: tuple) -> Iterator[np.ndarray]:
        """The stretches of one split; the brace after the end of a file that has none there is left out."""
        held = None
        for _, data in runs:
            if data is None:
                break
            if held is not None:
                yield held
            held = data
        if held is not None and key[4]:
            held = held[:-1]
        if held is not None and len(held):
            yield held

    runs = _runs(batches, ["no", "odd", "depth", "base", "open_end"])
    for key, data in runs:

        def stretches(data=data) -> Iterator:
            yield key, data
            for run in runs:  # not "yield from": that would close the runs of the splits to come
                yield run

        own = tuple(int(x) for x in key)
        for found in read(own, without_last(stretches(), own)):
            if found:
                yield sent(own[0], found)


def _splits(pieces: DataFrame) -> DataFrame:
    """Per split the state it begins in; one row per split, as many as the scan has tasks."""
    schema = "file string, block long, size long, bytes long, quotes long, outside long, inside long, first long"
    read = durable(pieces.mapInArrow(_summaries, schema)).withColumn("no", F.monotonically_increasing_id())
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    known = read.withColumns({
        "odd": F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2, "total": F.sum("bytes").over(whole),
        "last": F.max("block").over(whole), "opening": F.min_by("first", F.when(F.col("first") > 0, F.col("block"))).over(whole),
    })
    known = known.withColumn("deeper", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    open_end = (F.col("block") == F.col("last")) & (F.col("total") > F.col("size"))
    return known.select(
        "no", "file", "block", "odd", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"), "opening",
        F.when(F.col("opening") == ord("["), 1).otherwise(0).cast("long").alias("base"), open_end.cast("long").alias("open_end"),
    )


def json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``_file``, ``_block``, ``_index``, ``_text`` and ``_complete`` of every object; block and index order the objects of a file.

    A file that begins like neither an object nor an array has one row without text.
    """
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    pieces = spark.read.option("lineSep", "}").text(path).select(*meta, "value")
    splits = durable(_splits(pieces))
    # one row per split of the input, which the driver holds as a task anyway
    known = F.broadcast(splits.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "no", "odd", "depth", "base", "open_end"))
    placed = pieces.join(known, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select("no", "odd", "depth", "base", "open_end", "value")
    found = placed.mapInArrow(_objects, "no long, index long, kind string, text string")
    found = found.join(F.broadcast(splits.select("no", "file", "block")), "no")
    whole = found.filter("kind = 'whole'").select("file", "block", "index", "text", F.lit(True).alias("complete"))
    cut = found.filter("kind <> 'whole'")
    so_far = W.partitionBy("file").orderBy("block", "index").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = (
        cut.withColumn("object", F.count_if(F.col("kind") == "tail").over(so_far)).groupBy("file", "object")
        .agg(F.array_sort(F.collect_list(F.struct("block", "index", "text"))).alias("p"), F.bool_or(F.col("kind") == "head").alias("complete"))
    )
    joined = joined.select("file", F.get("p", F.lit(0))["block"].alias("block"), F.get("p", F.lit(0))["index"].alias("index"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), "complete")
    odd = splits.filter(F.col("opening").isNotNull() & ~F.col("opening").isin(ord("["), ord("{"))).groupBy("file").agg(F.min("block").alias("block"))
    odd = odd.select("file", "block", F.lit(-1).cast("long").alias("index"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("complete"))
    names = ["file", "block", "index", "text", "complete"]
    return whole.unionByName(joined).unionByName(odd).select(*[F.col(c).alias(f"_{c}") for c in names])


def read_json_docs(spark: SparkSession, path: str | list[str], schema: str, keep_bad: bool = False) -> DataFrame:
    """Files that hold one object or one array of objects: a row per object with its fields and ``_file``.

    With ``keep_bad`` the broken ones are rows too: ``_parse_error`` tells them and ``_text`` has what there is of them.
    """
    bad = "_corrupt_record"
    objects = json_objects(spark, path)
    parsed = F.from_json("_text", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    read = objects.select(F.inline(F.array(F.struct("_file", "_block", "_index", "_text", "_complete", parsed.alias("_j")))))
    broken = ~F.col("_complete") | F.col(f"_j.{bad}").isNotNull() | F.col("_j").isNull()
    rows = read.select("_j.*", "_file", "_block", "_index", "_text", broken.alias("_parse_error")).drop(bad)
    return rows if keep_bad else rows.filter(~F.col("_parse_error")).drop("_block", "_index", "_text", "_parse_error")
