"""How far the sources of a language are from each other, as a sparse merge per pair of sources.

1. *Counts.* A task counts the terms of its documents per group (language and
   source) before anything is shuffled; one shuffle by (language, term) sums
   them, tells which terms are in enough documents, and gives the counts of the
   whole language. Only kept terms are written.
2. *Blocks.* The kept terms of a language are dealt to blocks of bounded size
   and numbered inside; a group has per block its sorted arrays of ids and
   counts, empty where it holds none of the block's terms.
3. *Pairs.* Sources are dealt to tiles; two tiles and one block meet in a task,
   which merges each unordered pair once: the shorter array is looked up in the
   longer by galloping search, then shared, one-sided and absent terms are
   priced. Blocks are summed, and each sum serves both directions.

A term's share is ``1 + floor(10**9 * (count + 2) / (n + 2 * v))`` in whole
numbers; ``f`` of two shares is ``floor((p - q)**2 / (p + q))``. All exact up
to 9 * 10**15 terms per group.

Cases: null text, language or source are empty strings; groups without terms
take part with count 0 for each kept term; a language without kept terms has
value 0 for all pairs; a language of one source has no pairs; repeated rows are
documents of their own; ties go by the item's UTF-8 bytes; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemspark.llm.arrays import lower_ascii, stretches
from itemspark.llm.common import spread_join, written
from itemspark.session import durable, ship

ship(__name__)

#: Kept terms of a block and sources of a tile: what one pair task holds at most (about).
BLOCK_TERMS = 1 << 14
TILE_SOURCES = 16
_HELD_ROWS = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[65:91] = True
_LETTER[97:123] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all terms in order: the text's row, the code; and the different terms by code."""
    low = lower_ascii(data)
    inside = _LETTER[low]
    edge = np.zeros(len(low) + 1, bool)  # a term also ends where its text ends
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.nonzero(inside & (~before | edge[:-1]))[0]
    ends = np.nonzero(inside & (~after | edge[1:]))[0] + 1
    places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    every = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(low[inside].tobytes()))
    coded = every.dictionary_encode()
    return np.searchsorted(offsets, starts, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts per group of the task's texts, merged as they grow and sent when they are many."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
        return sums.select(["group", "term", "count_sum", "docs_sum"]).rename_columns(["group", "term", "count", "docs"])

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)]
        for part in table.to_batches(max_chunksize=1 << 16):
            at = part.column(0)
            yield pa.RecordBatch.from_arrays([names[0].take(at), names[1].take(at), *part.columns[1:]], ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        own = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
        for at, _, data, offsets in stretches(batch.column("text")):
            doc, code, names = _terms(data, offsets)
            if not len(code):
                continue
            key, n = np.unique(doc * len(names) + code, return_counts=True)  # one per document and term
            key, back, docs = np.unique(own[at + key // len(names)] * len(names) + key % len(names), return_inverse=True, return_counts=True)
            count = np.bincount(back, n).astype(np.int64)
            held.append(pa.table({"group": key // len(names), "term": names.take(pa.array(key % len(names))), "count": count, "docs": docs.astype(np.int64)}))
        if sum(len(t) for t in held) > _HELD_ROWS:
            held = [merged()]
            if len(held[0]) > _HELD_ROWS // 2:
                yield from sent(held.pop())
    if held:
        yield from sent(merged())


def group_terms(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``lang``, ``source``, ``term``, ``count`` and ``lang_count`` of the terms in at least ``min_docs`` documents of their language."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    # dealt by (lang, term), which serves the sum per source and the sum per language
    sums = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = W.partitionBy("lang", "term")
    found = sums.select("lang", "source", "term", "count", F.sum("count").over(whole).alias("lang_count"), F.sum("docs").over(whole).alias("lang_docs"))
    return found.filter(F.col("lang_docs") >= min_docs).drop("lang_docs")


def _share(count: str, n: str, v: str) -> Column:
    """The smoothed share in billionths; decimals, since the product does not fit a long."""
    return F.expr(f"1 + (cast({count} + 2 AS decimal(19,0)) * 1000000000) div cast({n} + 2 * {v} AS decimal(19,0))")


def _shares(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """The same for an array: long division in three digits of base 1000."""
    below, rest, out = n + 2 * v, count.astype(np.int64) + 2, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shared ids in both sorted arrays: each id of the shorter one is searched in the longer."""
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    hit = np.nonzero(long[at] == short)[0]
    return hit, at[hit]


def merge_pair(ids_a: np.ndarray, p_a: np.ndarray, none_a: int, ids_b: np.ndarray, p_b: np.ndarray, none_b: int, terms: int) -> int:
    """The divergence of two groups over one block: ids, shares, and the share of a term that a group lacks."""
    if len(ids_a) <= len(ids_b):
        in_a, in_b = _gallop(ids_a, ids_b)
    else:
        in_b, in_a = _gallop(ids_b, ids_a)
    shared = int(_price(p_a[in_a], p_b[in_b]).sum())
    lone_a = int(_price(p_a, np.int64(none_b)).sum() - _price(p_a[in_a], np.int64(none_b)).sum())
    lone_b = int(_price(p_b, np.int64(none_a)).sum() - _price(p_b[in_b], np.int64(none_a)).sum())
    absent = terms - len(ids_a) - len(ids_b) + len(in_a)
    return shared + lone_a + lone_b + absent * ((none_a - none_b) ** 2 // (none_a + none_b))


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for source, tile, n, v, terms, ids, counts in part[["source", "tile", "n", "v", "terms", "ids", "counts"]].itertuples(index=False):
        ids, counts = np.asarray(ids, np.int64), np.asarray(counts, np.int64)
        below = n + 2 * v
        none = int(_shares(np.zeros(1, np.int64), n, v)[0]) if below else 0
        rows.append((source, tile, ids, _shares(counts, n, v) if below else counts, none, terms))
    lang, low, high = part["lang"].iloc[0], part["low"].iloc[0], part["high"].iloc[0]
    found = []
    for i, (source, tile, ids, p, none, terms) in enumerate(rows):
        for other, other_tile, other_ids, other_p, other_none, _ in rows[i + 1 :]:
            if low == high or tile != other_tile:
                value = merge_pair(ids, p, none, other_ids, other_p, other_none, terms) if none else 0
                found.append((lang, min(source, other), max(source, other), value))  # one order for all blocks of a pair
    return pd.DataFrame(found, columns=["lang", "a", "b", "value"]).astype({"value": "int64"})


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value`` and ``rank`` within group and part."""
    kept = written(group_terms(docs, min_docs), "terms")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = named.distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_count").alias("lang_count"))
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_count").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left").na.fill(0, ["v", "lang_n"])
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS))).withColumn("tiles", F.ceil(F.col("sources") / TILE_SOURCES))
    groups = durable(groups.join(langs, "lang"))  # one row per group; the terms meet it and the languages without a hot task
    langs = durable(groups.groupBy(F.col("lang").alias("_lang")).agg(*[F.first(c).alias(c) for c in ("v", "blocks")]))

    # numbers of the terms in their blocks, and the size of each block
    dealt = spread_join(vocabulary.select("lang", "term"), langs, {"lang": "_lang"}, "v")
    dealt = dealt.select("lang", "term", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    ids = dealt.withColumn("id", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")))
    sizes = dealt.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))

    arrays = kept.join(ids, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "count"))).alias("held"))
    every = groups.select("lang", "source", "n", "v", "tiles", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    every = every.join(sizes, ["lang", "block"], "left").join(arrays, ["lang", "source", "block"], "left")
    tiled = every.select(
        "lang", "source", "n", "v", "block", F.coalesce("terms", F.lit(0)).alias("terms"), "tiles",
        F.coalesce(F.col("held.id"), F.array().cast("array<int>")).alias("ids"), F.coalesce(F.col("held.count"), F.array().cast("array<bigint>")).alias("counts"),
        F.pmod(F.xxhash64("source"), F.col("tiles")).alias("tile"),
    )
    met = tiled.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    met = met.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other", "tiles")
    merged = met.groupBy("lang", "block", "low", "high").applyInPandas(_merge, "lang string, a string, b string, value long")
    sums = merged.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pairs = _ranked(both.select("lang", "x.source", "x.item", "value"), "pair")

    sums = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "n", "v", "lang_n")
    told = spread_join(kept, sums, {"lang": "_lang", "source": "_source"}, "n")
    told = told.select("lang", "source", F.col("term").alias("item"), _share("count", "n", "v").alias("p"), _share("lang_count", "lang_n", "v").alias("q"))
    over = told.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    terms = _ranked(over, "term").filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
