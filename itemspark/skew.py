"""Helpers that keep hot keys out of single tasks.

Three situations occur in this package:

* *few rows per key* are wanted: ``row_number() <= k`` - Spark prunes each map
  task to k rows per key before the shuffle (``WindowGroupLimit``), nothing to add;
* *every row needs its position* in its key: :func:`position_in_group` splits a
  key into value slices, ranks inside a slice and adds the size of the earlier
  slices; :func:`dense_number` does it for the whole table;
* *many rows meet one row per key*: :func:`salted_lookup` repeats the one row
  over a fixed number of salts, so a hot key is spread over that many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark.session import durable, stored

_LEAST_SLICES = 64


def _order(spec: str) -> tuple[str, bool]:
    """``"-score"`` means descending."""
    return (spec[1:], False) if spec.startswith("-") else (spec, True)


def ordering(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in map(_order, order)]


def _slice_of(cuts: Sequence[float], value: Column) -> Column:
    """Twice the number of cuts below the value, and one more where it equals a cut: odd slices hold one value."""
    if not cuts:
        return F.lit(0)
    at = F.array(*map(F.lit, cuts))
    return 2 * F.size(F.filter(at, lambda cut: cut < value)) + F.array_contains(at, value).cast("int")


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos", up_to: int | None = None
) -> DataFrame:
    """Exact 1-based position of every row in its key, for numeric non-null order columns.

    Slice bounds are global quantiles (as many numbers per order column on the
    driver as there are shuffle partitions, 64 at least), so a slice of any key
    holds about that share of the table even when one key owns most rows. A
    value that many rows have is a bound, and its rows are a slice of their own;
    only there the next column cuts further, since only there it decides. Bounds
    enter the plan as literals, which keeps the slicing the same when a task is
    run again. ``up_to`` drops later rows before they are shuffled for ranking.
    """
    specs = [_order(c) for c in order]
    n = max(_LEAST_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    bounds = df.agg(
        *[F.percentile_approx(c, shares, 16 * n).alias(f"q{i}") for i, (c, _) in enumerate(specs)]
    ).first()
    slices, tied = [], F.lit(True)
    for i, (c, up) in enumerate(specs):
        own = _slice_of(sorted(set(bounds[f"q{i}"] or [])), F.col(c))
        slices.append(F.when(tied, own if up else -own).otherwise(0).alias(f"_s{i}"))
        tied = tied & (own % 2 == 1)
    names = [f"_s{i}" for i in range(len(specs))]
    cut = df.select("*", *slices)
    group = [*keys, *names]
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        cut.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if up_to is not None:
        sizes = sizes.filter(F.col("_before") < up_to)
    twins = {c: f"_k{i}" for i, c in enumerate(group)}
    sizes = sizes.select(*[F.col(c).alias(t) for c, t in twins.items()], "_before")
    on = [F.col(c).eqNullSafe(F.col(t)) for c, t in twins.items()]
    joined = cut.join(sizes, on, "inner").drop(*twins.values())
    rn = F.row_number().over(W.partitionBy(*group).orderBy(*ordering(order)))
    ranked = joined.withColumn(out, (rn + F.col("_before")).cast("long")).drop("_before", *names)
    return ranked if up_to is None else ranked.filter(F.col(out) <= up_to)


def dense_number(df: DataFrame, order: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """Number all rows densely in the given (unique) order without a one-task sort.

    Range partitions are sorted in parallel and written once to the shared
    checkpoint folder, so the position of a row inside its partition cannot move
    when an executor is lost; the start of each partition comes from one count
    per partition. Only the order columns and the number are sorted; the other
    columns are joined to them. The rows are written once before, since the
    bounds of the ranges, the sort and the join each read them.
    """
    own = [_order(c)[0] for c in order]
    if set(own) != set(df.columns):
        df = stored(df)
        keys = {c: f"_key{i}" for i, c in enumerate(own)}
        numbers = dense_number(df.select(*own), order, out, start).select(*[F.col(c).alias(k) for c, k in keys.items()], out)
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
        return df.join(numbers, same).drop(*keys.values())
    parts = durable(df.repartitionByRange(*ordering(order)).sortWithinPartitions(*ordering(order)))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = parts.select("*", F.spark_partition_id().alias("_pid"), inside.alias("_in"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # one row per partition: bounded by spark.sql.shuffle.partitions
    return (
        tagged.join(F.broadcast(starts), "_pid")
        .withColumn(out, (F.col("_start") + F.col("_in") + start).cast("long"))
        .drop("_pid", "_in", "_start")
    )


def salted_lookup(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], salt_on: str, how: str = "left", salts: int | None = None
) -> DataFrame:
    """Join many rows to one row per key with each key spread over ``salts`` tasks (as many as shuffle partitions, 16 at least)."""
    salts = salts or max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def settle(df: DataFrame) -> DataFrame:
    """Keep the optimiser from copying the (long) column expressions of ``df`` into later steps.

    Filters are pushed through projections by substitution, which multiplies
    chained rule columns; they are not pushed through a generator. It emits one
    row per row and runs inside the same stage.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def on_all_cores(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan that has fewer splits than the session has cores; any larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, out: str | None = None) -> DataFrame:
    """First ``k`` rows per key; map tasks keep k rows per key before the shuffle."""
    name = out or "_rn"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*ordering(order))))
    kept = ranked.filter(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("long")) if out else kept.drop(name)
