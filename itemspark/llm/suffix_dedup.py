"""Removing repeated byte strings by suffix arrays over a difference cover.

A text is judged by its windows of ``window`` bytes: a byte goes when a window
over it also starts anywhere else. The steps:

1. *Partition of the suffixes.* The smallest hash of the short grams inside a
   window names the window; equal windows have equal names. Windows of one name
   that follow each other form a *stretch* of text. Names seen once (two Bloom
   filters tell) cannot repeat and are left out.
2. *Copies.* Stretches are counted by digest; those found twice are repeated in
   all their windows, wherever they stand.
3. *Suffix order.* The remaining stretches, with one copy of each repeated one,
   are dealt to tasks by name. A task sorts their suffixes with a difference
   cover: triples of eight-byte symbols are sorted and named at two places of
   three, named triples are sorted again until a name spans a window, the
   remaining suffixes are merged by their first symbol and the name behind it,
   and neighbours in the order are compared over the whole window.
4. Names with very many different stretches are not sorted in one task: their
   windows are counted one by one like stretches of one window.

Cases: null text is empty; texts shorter than a window keep everything; repeated
rows and copies lose all of what they share; repetitions within one text count;
a null id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.arrays import STRETCH, TwiceFilter, _power_tables, mix, span_hashes, texts_of, twice_seen
from itemspark.session import shared_folder, ship

ship(__name__)

_U = np.uint64
_GRAM = 32
_NONE = _U(0xFFFFFFFFFFFFFFFF)
#: Different stretches of one name that a task sorts.
NAME_STRETCHES = 3_000
#: Bytes of one suffix array, the rows of one name not counted; names of symbols fit 21 bits with them.
ARRAY_BYTES = 1 << 19
_FINE = 1 << 17


def _fine_stretches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of pieces small enough for the processor's cache; a longer text is a piece of its own."""
    data, offsets = texts_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _FINE, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NONE)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def named_stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: name, text row, first and last start of each stretch of one name."""
    if len(data) < window:
        return np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    power, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
        grams = mix((sums[_GRAM:] - sums[:-_GRAM]) * inverse[: len(data) - _GRAM + 1])
    # the place stands in the low bits, as many for every length, so that equal windows choose alike;
    # of equal grams the leftmost counts, and each place has a run of its own
    low = _U(0xFFFFFFFF)
    place = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=_U), window - _GRAM + 1) & low
    names = grams[place.astype(np.int64)]
    full = np.zeros(len(names) + 1, bool)  # windows that stay in their text
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= window:
            full[a : b - window + 1] = True
    begins = np.zeros(len(names) + 1, bool)
    begins[0] = True
    begins[1:-1] = place[1:] != place[:-1]
    begins[1:] |= full[1:] != full[:-1]
    begins[offsets[offsets < len(names)]] = True
    at = np.nonzero(begins)[0]
    first, last = at[:-1], at[1:] - 1
    if len(at) and at[-1] < len(names):
        first, last = at, np.append(at[1:] - 1, len(names) - 1)
    good = full[first]
    first, last = first[good], last[good]
    return names[first], np.searchsorted(offsets, first, side="right") - 1, first, last


def _names(window: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, size = [], 0
        for _, data, offsets in _fine_stretches(batch.column("text")):
            held.append(named_stretches(data, offsets, window)[0])
            size += len(held[-1])
            if size > STRETCH:
                yield np.concatenate(held)
                held, size = [], 0
        yield np.concatenate([*held, np.zeros(0, _U)])

    return run


def _stretch_rows(window: int, seen, mode: str, crowded):
    """Rows of stretches whose name may repeat.

    ``mode`` "places": where they stand; "bodies": also their bytes, once per
    piece of text, without crowded names; "windows": crowded names only, every
    window as a stretch of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = TwiceFilter(*seen.value)
        for batch in batches:
            for row, data, offsets in _fine_stretches(batch.column("text")):
                name, of, first, last = named_stretches(data, offsets, window)
                keep = filtered.holds(name)
                if mode != "places":
                    keep &= crowded.value[(name & _U(CROWDED_MARKS - 1)).astype(np.int64)] == (mode == "windows")
                name, of, first, last = name[keep], of[keep], first[keep], last[keep]
                if mode == "windows":
                    n = last - first + 1
                    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    first = np.repeat(first, n) + inside
                    name, of, last = np.repeat(name, n), np.repeat(of, n), first
                if not len(name):
                    continue
                digest = span_hashes(data, first, last + window)
                rows = pa.array(row + of)
                arrays = [
                    batch.column("doc_id").take(rows), batch.column("t").take(rows), pa.array(name.view(np.int64)), pa.array(digest.view(np.int64)),
                    pa.array(first - offsets[of]), pa.array((last - first + 1).astype(np.int32)),
                ]
                labels = ["doc_id", "t", "name", "digest", "start", "windows"]
                if mode == "bodies":
                    raw = data.tobytes()
                    new = np.zeros(len(name), bool)
                    new[np.unique(digest, return_index=True)[1]] = True
                    arrays.append(pa.array([raw[a : b + window] if f else None for a, b, f in zip(first, last, new, strict=True)], pa.binary()))
                    labels.append("body")
                yield pa.RecordBatch.from_arrays(arrays, labels)

    return run


def _ranked(values: np.ndarray) -> np.ndarray:
    """Rank of every value among the different ones, from 1."""
    order = np.argsort(values)
    sorted_values = values[order]
    new = np.ones(len(values), np.int64)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _packed(*names: np.ndarray) -> np.ndarray:
    out = names[0].astype(_U)
    for n in names[1:]:
        out = (out << _U(21)) | n.astype(_U)
    return out


def repeated_starts(text: np.ndarray, wanted: np.ndarray, window: int) -> np.ndarray:
    """Which of the ``wanted`` starts (ascending) have a window that also starts at another of them.

    ``text`` ends in at least 300 bytes that no wanted window reaches.
    """
    n = len(text) - 8
    symbol = np.zeros(n, _U)
    for k in range(8):
        symbol = (symbol << _U(8)) | text[k : k + n].astype(_U)
    rank = _ranked(symbol)
    ahead = lambda x, by: np.concatenate((x[by:], np.zeros(min(by, len(x)), x.dtype)))
    # the cover: symbols stand eight bytes apart; two of three are sampled
    sampled = (np.arange(n) >> 3) % 3 != 0
    at = np.nonzero(sampled)[0]
    name, span = np.zeros(n, np.int64), 8
    triple = _packed(rank, ahead(rank, 8), ahead(rank, 16))
    name[at] = _ranked(triple[at])
    span *= 3
    while span < window:
        triple = _packed(name, ahead(name, span), ahead(name, 2 * span))
        name = np.zeros(n, np.int64)
        name[at] = _ranked(triple[at])
        span *= 3
    kind = (wanted >> 3) % 3
    sample, rest = wanted[kind != 0], wanted[kind == 0]
    key2 = lambda i: _packed(rank[i], name[i + 8])
    key3 = lambda i: _packed(rank[i], rank[i + 8], name[i + 16])
    sample = sample[np.argsort(name[sample], kind="stable")]
    rest = rest[np.argsort(key2(rest), kind="stable")]
    before = np.where(
        (sample >> 3) % 3 == 1,
        np.searchsorted(key2(rest), key2(sample)),
        np.searchsorted(np.maximum.accumulate(key3(rest)) if len(rest) else key3(rest), key3(sample)),
    )
    # equal windows may differ behind the window; their common place is the largest one
    slots = np.arange(len(sample)) + np.maximum.accumulate(before) if len(sample) else np.zeros(0, np.int64)
    order = np.full(len(wanted), -1, np.int64)
    order[slots] = sample
    order[order < 0] = rest
    same = np.ones(max(len(order) - 1, 0), bool)
    whole, tail = divmod(window, 8)
    for k in [8 * j for j in range(whole)] + ([window - 8] if tail else []):
        same &= symbol[order[:-1] + k] == symbol[order[1:] + k]
    twice = np.zeros(n, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return twice[wanted]


def _sort_bucket(window: int):
    def arrays_of(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows in arrays of bounded size; the rows of one name stay together."""
        size, begin, last = 0, 0, None
        names, lengths = part["name"].to_numpy(), part["body"].str.len().to_numpy()
        for i in range(len(part)):
            if size > ARRAY_BYTES and names[i] != last:
                yield part.iloc[begin:i]
                size, begin = 0, i
            size, last = size + int(lengths[i]), names[i]
        yield part.iloc[begin:]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.sort_values("name", kind="stable")
        single_names = set(part.loc[part["copies"] == 1, "name"])
        several = part["name"].duplicated(keep=False) | (part["copies"] > 1) | (part["windows"] > 1)
        part = part[part["name"].isin(single_names) & several]
        for rows in arrays_of(part) if len(part) else ():
            bodies = rows["body"].to_numpy()
            lengths = np.array([len(b) for b in bodies], np.int64)
            text = np.frombuffer(b"".join(bodies) + bytes(320), np.uint8)
            begin = np.cumsum(lengths) - lengths
            n = lengths - window + 1
            owner = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = repeated_starts(text, begin[owner] + inside, window) & (rows["copies"].to_numpy()[owner] == 1)
            edge = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1])))
            first = np.nonzero(edge)[0]
            last = np.append(first[1:] - 1, len(hit) - 1)
            first, last = first[hit[first]], last[hit[first]]
            of = owner[first]
            start = rows["start"].to_numpy()[of]
            out.append(pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[of], "t": rows["t"].to_numpy()[of], "lo": start + inside[first], "hi": start + inside[last]}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "t": [], "lo": [], "hi": []})

    return run


#: Marks of crowded names; a name that meets a mark by chance takes the other, equally exact way.
CROWDED_MARKS = 1 << 20


def _crowded(counts: DataFrame) -> np.ndarray:
    """Marks of the names of very many stretches; what comes to the driver is bounded by the number of marks."""
    names = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NAME_STRETCHES)
    marks = np.zeros(CROWDED_MARKS, bool)
    marks[[r["mark"] for r in names.select(F.col("name").bitwiseAND(F.lit(CROWDED_MARKS - 1)).alias("mark")).distinct().collect()]] = True
    return marks


def repeated_windows(docs: DataFrame, window: int = 200, bits: int = 1 << 28) -> DataFrame:
    """Runs of window starts that repeat (``doc_id``, ``t``, ``lo``, ``hi``) for documents (``doc_id``, ``text``, ``t`` = hash of text)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    share = spark.sparkContext.broadcast
    seen = share(twice_seen(docs, ["text"], _names(window), bits).parts())  # plain arrays: workers need no package
    schema = f"doc_id {id_type}, t long, name long, digest long, start long, windows int"
    folder = f"{shared_folder(spark)}/stretches-{uuid.uuid4().hex}"
    docs.mapInArrow(_stretch_rows(window, seen, "places", None), schema).write.option("compression", "zstd").parquet(folder)
    places = spark.read.parquet(folder)

    counts = places.groupBy("name", "digest").agg(F.count(F.lit(1)).alias("copies"))
    marks = _crowded(counts)
    crowded = share(marks)

    def copied(rows: DataFrame) -> DataFrame:
        often = rows.groupBy("name", "digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        often = often.select(F.col("name").alias("_name"), F.bitwise_not("digest").alias("_digest"))
        # by another key than the counts are grouped by: both sides are shuffled for the join itself,
        # and only then may Spark split a stretch that many documents hold
        both = rows.join(often, (F.bitwise_not("digest") == F.col("_digest")) & (F.col("name") == F.col("_name")))
        return both.select("doc_id", "t", F.col("start").alias("lo"), (F.col("start") + F.col("windows") - 1).alias("hi"))

    found = copied(places)
    if marks.any():
        found = found.unionByName(copied(docs.mapInArrow(_stretch_rows(window, seen, "windows", crowded), schema)))
    bodies = docs.mapInArrow(_stretch_rows(window, seen, "bodies", crowded), schema + ", body binary")
    # of a stretch with one copy these are its own values
    each = bodies.groupBy("name", "digest").agg(F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("doc_id", "t", "start", "windows", "body")])
    rows_per_bucket = 8_000
    # by the number of places, which the written table tells without a shuffle
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places.count() // rows_per_bucket))
    dealt = each.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets))).drop("digest")
    sorted_runs = dealt.groupBy("bucket").applyInPandas(_sort_bucket(window), f"doc_id {id_type}, t long, lo long, hi long")
    return found.unionByName(sorted_runs)


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept_hash, kept = [], [], [], [], []
            lows, highs = batch.column("los").to_pylist(), batch.column("his").to_pylist()
            for text, lo, hi in zip(batch.column("text"), lows, highs, strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                left, spans, at = [], 0, 0
                for a, b in sorted(zip(lo or (), hi or (), strict=True)):
                    if a > at or not spans:
                        left.append(raw[at:a])
                        spans += 1
                    at = max(at, b + window)
                left.append(raw[at:])
                rest = b"".join(left)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                n_spans.append(spans)
                kept_hash.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            arrays = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept_hash, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 200, bits: int = 1 << 28) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (bytes, which may cut a character) per row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    runs = repeated_windows(texts, window, bits)
    per_doc = runs.groupBy("doc_id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("runs.lo").alias("los"), F.col("runs.hi").alias("his"))
    joined = texts.join(per_doc, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "los", "his").mapInArrow(_remove(window), schema)
