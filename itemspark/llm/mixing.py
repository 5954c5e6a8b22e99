"""Mixing sources to target weights by a low-discrepancy schedule.

Documents of a source are shuffled by hash and laid on one line of words, which
is cut into equal blocks. Points i * golden ratio (mod 1) go through the
cumulative shares of the sources and so name the source of slot i; the slots of
a source are ranked, and slot r takes its block r, beginning again after the
last block. No source gives a block more than twice.

A block has ``block_words`` words, fewer in a source of under a thousand such
blocks, so that small sources also come near their target.

Cases: a null text has no words; a null source is a source of its own, the last;
documents without words are never taken and stay in the result; repeated rows
are documents of their own, neighbours in the shuffled order; an empty table
gives no rows.
Extra columns are not read. Running sums go through buckets, so that no source
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemspark.llm.common import SPACE_CLASS, free_names, with_text, words
from itemspark.session import durable

#: Weights of the sources by code point, repeating; the mix has 150 % of all words; a source gives twice its words at most.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 1024
_GOLDEN = 0.6180339887498949
_BUCKET_ROWS, _SLOT_CHUNK = 10_000, 8192


def count_words(text: Column) -> Column:
    """Words of a text; a split leaves one empty piece at an end that is white space."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS)
    edge = lambda i: (F.element_at(parts, i) == "").cast("long")
    return (F.size(parts) - edge(1) - F.when(F.size(parts) > 1, edge(-1)).otherwise(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: ``source_size``, ``weight`` and ``target``.

    Sources that stop at their most are those of the smallest ratio of most to
    weight; the level of the rest follows from running sums. One row per source.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int"))
    ranked = one.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "weight", "source_size", F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # the level that sources from this one on would share; it rises while sources stop at their most, then falls
    left = (F.sum("source_size").over(everything) * SHARE - earlier("most")) / (F.sum("weight").over(everything) - earlier("weight"))
    leveled = ranked.withColumn("left", left).withColumn("level", F.max("left").over(everything))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    block = F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(F.col("source_size") / 1000))).cast("long")
    return leveled.select(
        "source",
        F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("source_no"),
        "source_size",
        target.alias("target"),
        block.alias("block_words"),
        F.ceil(F.col("source_size") / block).alias("n_blocks"),
        F.round(target / block).cast("long").alias("n_slots"),
    )


def point(i: Column) -> Column:
    """Fraction of i * golden ratio; high and low bits apart, so that large numbers keep their fraction."""
    step = 1 << 20
    x = F.floor(i / step) * F.lit((step * _GOLDEN) % 1.0) + (i % step) * F.lit(_GOLDEN)
    return x - F.floor(x)


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """The mix as slots: ``slot``, ``source_no``, ``epoch``, ``block``.

    Slots beyond a source's quota are left out; should the points of a source
    end before its quota, its last slots stand at the end of the schedule.
    """
    spark = sources.sparkSession
    bins = 4096
    order = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)
    ends = sources.select("source_no", "n_slots", "n_blocks", (F.sum("n_slots").over(order) / max(n_slots, 1)).alias("hi"), (F.col("n_slots") / max(n_slots, 1)).alias("share"))
    shares = ends.filter("n_slots > 0").withColumn("lo", F.col("hi") - F.col("share"))
    bin_of = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(x * bins).cast("int")))
    binned = shares.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo") - 1e-9), bin_of(F.col("hi") + 1e-9))))
    binned = binned.select("bin", "source_no", "n_slots", "n_blocks", "lo", "hi")
    slots = spark.range(n_slots + n_slots // 100 + 64).select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("x")).withColumn("bin", bin_of(F.col("x")))
    named = slots.join(binned, "bin").filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).withColumn("chunk", F.floor(F.col("slot") / _SLOT_CHUNK))
    counts = named.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("source_no").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("r", inside).join(starts, (F.col("source_no") == F.col("_s")) & (F.col("chunk") == F.col("_c")))
    ranked = ranked.select("slot", "source_no", (F.col("first") + F.col("r")).alias("rank"), "n_slots", "n_blocks").filter("rank < n_slots")
    reached = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    short = shares.join(reached, "source_no", "left").filter(F.coalesce("n", F.lit(0)) < F.col("n_slots"))
    rest = F.explode(F.sequence(F.coalesce("n", F.lit(0)).cast("long"), F.col("n_slots") - 1))
    last = short.select("source_no", "n_slots", "n_blocks", rest.alias("rank"))
    last = last.select((F.col("rank") + 2 * n_slots + 64).alias("slot"), "source_no", "rank", "n_slots", "n_blocks")
    both = ranked.unionByName(last)
    return both.select("slot", "source_no", F.floor(F.col("rank") / F.col("n_blocks")).cast("int").alias("epoch"), (F.col("rank") % F.col("n_blocks")).alias("block"))


def lay_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents in the shuffled order of their source: ``bucket``, ``place`` and ``start``, their first word on the source's line."""
    buckets = max(1, -(-sizes.count() // _BUCKET_ROWS))
    shuffled = sizes.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    # one row per source: Spark sends it to all tasks when its size at run time is below its limit, and splits a hot source otherwise
    known = shuffled.join(sources, shuffled["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    sums = known.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = sums.select(F.col("source_no").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    order = W.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "t")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = known.withColumn("inside", inside).withColumn("place", F.row_number().over(order))
    joined = placed.join(firsts, (F.col("source_no") == F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return joined.withColumn("start", F.col("first") + F.col("inside")).drop("_s", "_b", "first", "inside", "h")


def mix(docs: DataFrame) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``taken``.

    ``by_epoch`` has the words taken in the first and in the second round over
    its source, ``t`` a hash of the text.
    """
    sizes = durable(docs.select("doc_id", "source", F.xxhash64("text").alias("t"), count_words(F.col("text")).alias("size")))
    sources = durable(targets(sizes))
    n_slots = int(sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0])
    times = schedule(sources, n_slots).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    placed = lay_out(sizes, sources)
    end, b = F.col("start") + F.col("size"), F.col("block_words")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b)))
    pieces = placed.withColumn("block", F.explode_outer(blocks))
    words = F.least(end, (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
    pieces = pieces.withColumn("words", words).join(times, ["source_no", "block"], "left")
    took = lambda epoch: F.sum(F.when(F.col("times") > epoch, F.col("words")).otherwise(0))
    by_doc = pieces.groupBy("source_no", "bucket", "place", "doc_id", "source", "t", "size", "source_size", "target").agg(took(0).alias("first_epoch"), took(1).alias("second_epoch"))
    return by_doc.select(
        "doc_id", "source", "t", "size", "source_size", "target",
        (F.col("first_epoch") + F.col("second_epoch")).cast("long").alias("taken"),
        F.array("first_epoch", "second_epoch").alias("by_epoch"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each round that takes a document; same columns.

    A document at the end of its source's quota is cut to the words that are
    taken, all others are whole.
    """
    key, number, size, epochs, taken = free_names(docs, "key", "number", "size", "epochs", "taken")
    count = F.row_number().over(W.partitionBy(key).orderBy(key)).alias(number)
    named = lambda t: F.xxhash64("doc_id", "source", t).alias(key)
    took = mix(docs).select(named(F.col("t")), F.col("size").alias(size), F.col("by_epoch").alias(epochs)).select("*", count)
    rows = docs.select("*", named(F.xxhash64("text"))).select("*", count)
    rounds = rows.join(took, [key, number]).withColumn(taken, F.explode(epochs)).filter(F.col(taken) > 0)
    text = F.when(F.col(taken) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(taken).cast("int")), " "))
    return with_text(rounds, text).select(*docs.columns)
