"""Key joins: items with results, plans with examples and rules, runs with runs.

No join carries an unchecked broadcast hint: sizes at run time decide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark import skew
from itemspark.functions import classes
from itemspark.functions import fixed_values as V
from itemspark.functions.text import short_standard

KEY = ("standard", "difficulty", "type")
PAIR = ("standard", "difficulty")


def join_items_results(items: DataFrame, results: DataFrame, on: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Every item with its score: the listed score first, the nested result's second."""
    own = results.select(*on, F.coalesce("list_score", "nested_score").alias("score"))
    return items.join(own, list(on), "left")


def failed_keys(
    df: DataFrame, keys: Sequence[str] = PAIR, passing: float = V.PASS_SCORE, missing_fails: bool = True
) -> DataFrame:
    """Keys with any row below the threshold (or without a score)."""
    low = F.col("score") < passing
    return df.filter(low | F.col("score").isNull() if missing_fails else low).select(*keys).distinct()


def scored_item_join(
    generated: DataFrame, recipes: DataFrame, results: DataFrame, subjects: Sequence[str], grade: str,
    min_score: float = V.PASS_SCORE,
) -> DataFrame:
    """Scored items of a grade from three tables; the difficulty sits inside the response JSON."""
    difficulty = F.get_json_object("response", "$.difficulty")
    g = generated.withColumn("difficulty", difficulty).filter(
        F.col("question_type").isin(V.ITEM_TYPES) & F.col("difficulty").isin(V.DIFFICULTIES)
    )
    r = recipes.filter(
        F.col("subject").isin(list(subjects)) & (F.col("grade_level") == grade)
        & F.col("standard").startswith(V.STANDARD_PREFIX.rstrip("."))
    )
    a = results.filter(F.col("score") >= min_score)
    return g.join(r, "recipe_id").join(a, "question_id").select(
        "question_id", "standard", "question_type", "difficulty", "score", "response", "standard_desc"
    )


def coverage_gap(rows: DataFrame, examples: DataFrame, keys: Sequence[str] = PAIR, passing: float = V.PASS_SCORE) -> DataFrame:
    """Low or unscored rows, each told whether its key has an example."""
    low = rows.filter(F.col("score").isNull() | (F.col("score") < passing))
    have = examples.select(*keys).distinct().withColumn("_has", F.lit(True))
    return low.join(have, list(keys), "left").withColumn("has_example", F.coalesce("_has", F.lit(False))).drop("_has")


def merge_by_rank(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY, k: int = 2, min_score: float = V.PASS_SCORE
) -> DataFrame:
    """Challenge the r-th best current row of a key by the r-th best incoming one, r <= k.

    A strictly better challenger replaces, a missing rank is filled; current rows
    beyond rank k stay. Both inputs have ``ordinal`` and ``score`` and the same columns;
    the result adds ``action``: kept, replaced or filled.
    """
    cols = current.columns
    zero = current.withColumn("score", F.coalesce("score", F.lit(0.0)))
    new = skew.top_rows(incoming.filter(F.col("score") >= min_score), keys, ["-score", "ordinal"], k, out="rank")
    old = skew.top_rows(zero, keys, ["-score", "ordinal"], k, out="rank")
    pack = [c for c in cols if c not in keys]
    both = old.select(*keys, "rank", F.struct(*pack).alias("old")).join(
        new.select(*keys, "rank", F.struct(*pack).alias("new")), [*keys, "rank"], "full"
    )
    wins = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.score") > F.col("old.score")))
    action = F.when(~wins, "kept").when(F.col("old").isNull(), "filled").otherwise("replaced")
    ranked = both.withColumn("action", action).withColumn("row", F.when(wins, F.col("new")).otherwise(F.col("old")))
    ranked = ranked.select(*keys, "row.*", "action").select(*cols, "action")
    beyond = zero.join(old.select(*keys, "ordinal"), [*keys, "ordinal"], "left_anti")
    return ranked.unionByName(beyond.withColumn("action", F.lit("kept")))


def replace_by_key(existing: DataFrame, new: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """New rows replace all existing rows of their key."""
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return new.unionByName(kept)


def merge_partial_run(best: DataFrame, new: DataFrame, keys: Sequence[str] = KEY, partial: bool = True) -> DataFrame:
    """Complete a run that only redid some keys from the best run so far.

    Best rows of other keys are kept with their score, and the new rows are still
    to be scored. A run over all keys (``partial`` false) stands alone.
    """
    if not partial:
        best = best.limit(0)
    kept = best.join(new.select(*keys).distinct(), list(keys), "left_anti")
    fresh = new.withColumn("score", F.lit(None).cast("double")).withColumn("to_score", F.lit(True))
    return kept.withColumn("to_score", F.col("score").isNull()).unionByName(fresh)


def plan_cross(
    standards: DataFrame, difficulties: Sequence[str] = tuple(V.DIFFICULTIES), types: Sequence[str] = tuple(V.ITEM_TYPES)
) -> DataFrame:
    """Every (standard, difficulty, type); ``type_pos`` and ``difficulty_pos`` give the type-major order."""
    kinds = F.posexplode(F.array(*map(F.lit, types))).alias("type_pos", "type")
    levels = F.posexplode(F.array(*map(F.lit, difficulties))).alias("difficulty_pos", "difficulty")
    return standards.select("standard").distinct().select("standard", kinds).select("*", levels)


def lookup_standard(plan: DataFrame, curriculum: DataFrame, fallback: DataFrame) -> DataFrame:
    """Curriculum fields per plan row; the description falls back to a second table."""
    first = curriculum.withColumnRenamed("standard_description", "_d1")
    second = fallback.select("standard", F.col("standard_description").alias("_d2"))
    out = plan.join(first, "standard", "left").join(second, "standard", "left")
    return out.withColumn("standard_description", F.coalesce(F.nullif("_d1", F.lit("")), "_d2")).drop("_d1", "_d2")


LEVELS = [("standard", "difficulty", "type"), ("standard", "type"), ("difficulty", "type"), ("type",), ("standard", "difficulty")]


def retrieve_examples(plan: DataFrame, examples: DataFrame, k: int = 2) -> DataFrame:
    """Top ``k`` examples per plan key from the closest level that has any.

    The examples are read once: each stands under its key of every level, which
    is blank in the columns the level leaves out, and at most k per level key
    are kept before the one join. The last level ignores type and score and
    keeps input order.
    """
    cols = [c for c in examples.columns if c not in KEY]
    places = [f"_{c}" for c in KEY]

    def under_levels(rows: DataFrame, *more: Column) -> DataFrame:
        def place(level: int, on: Sequence[str]) -> Column:
            own = [(F.col(c) if c in on else F.lit("")).alias(p) for c, p in zip(KEY, places, strict=True)]
            return F.when(F.forall(F.array(*[F.col(c) for c in on]), lambda c: c.isNotNull()), F.struct(F.lit(level).cast("long").alias("level"), *own))

        listed = F.filter(F.array(*[place(i, on) for i, on in enumerate(LEVELS, start=1)]), lambda x: x.isNotNull())
        return rows.select(*more, F.explode(listed).alias("_x")).select("*", "_x.*").drop("_x")

    told = F.struct(*cols, *[F.col(c).alias(f"example_{c}") for c in KEY]).alias("e")
    listed = under_levels(examples, told, F.col("score").alias("_score"), F.col("ordinal").alias("_ordinal"))
    listed = listed.withColumn("_score", F.when(F.col("level") < len(LEVELS), F.col("_score")))
    best = skew.top_rows(listed, ["level", *places], ["-_score", "_ordinal"], k, out="rank").drop("_score", "_ordinal")
    keys = under_levels(plan.select(*KEY).distinct(), *map(F.col, KEY))
    found = keys.join(best, ["level", *places]).select(*KEY, "level", "rank", "e.*")
    closest = F.min("level").over(W.partitionBy(*KEY))
    return found.withColumn("_closest", closest).filter("level = _closest").drop("_closest")


def lookup_rules(plan: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the standard first, then those of the full key, in their stored order."""
    keys = plan.select(*KEY).distinct()
    by_standard = rules.filter("scope = 'standard'").select("standard", F.lit(1).cast("long").alias("part"), "pos", "rule")
    by_key = rules.filter("scope = 'standard_difficulty'").select(*KEY, F.lit(2).cast("long").alias("part"), "pos", "rule")
    cols = [*KEY, "part", "pos", "rule"]
    return keys.join(by_standard, "standard").select(*cols).unionByName(keys.join(by_key, list(KEY)).select(*cols))


def lookup_negatives(plan: DataFrame, negatives: DataFrame) -> DataFrame:
    return plan.select(*KEY).distinct().join(negatives, list(KEY), "left")


def compare_runs(old: DataFrame, new: DataFrame, eps: float = 0.01, passing: float = V.PASS_SCORE) -> DataFrame:
    """Change per re-run weak row; only an improved row can newly pass."""
    out = old.select("ordinal", F.col("score").alias("old_score")).join(
        new.select("ordinal", F.col("score").alias("new_score")), "ordinal", "left"
    )
    delta = F.col("new_score") - F.col("old_score")
    change = (
        F.when(F.col("new_score").isNull(), "missing").when(delta > eps, "improved").when(delta < -eps, "degraded")
        .otherwise("unchanged")
    )
    passed = (change == "improved") & (F.col("new_score") >= passing)
    return out.withColumn("change", change).withColumn("newly_passed", passed)


def apply_improvements(rows: DataFrame, comparison: DataFrame) -> DataFrame:
    """Put the new score of newly passed rows in place of the old one."""
    better = comparison.filter("newly_passed").select("ordinal", "new_score")
    out = rows.join(better, "ordinal", "left")
    return out.withColumn("replaced", F.col("new_score").isNotNull()).withColumn(
        "score", F.coalesce("new_score", "score")
    ).drop("new_score")


def pass_rate_over_all(rows: DataFrame, passing: float = V.PASS_SCORE) -> DataFrame:
    """Pass rate over all rows; a missing score counts as a failure."""
    from itemspark.operators.aggs import percent

    got = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= passing).alias("pass_count"))
    return got.withColumn("pass_rate", percent("pass_count", "total"))


def usage_with_price(calls: DataFrame) -> DataFrame:
    """Cost of every call; unknown models get their provider's default price.

    The price table has a fixed number of rows, so it may be broadcast.
    """
    prices = F.broadcast(classes.price_table(calls.sparkSession))
    keyed = calls.withColumn("model_key", classes.model_key(F.col("provider"), F.col("model")))
    out = keyed.join(prices, ["provider", "model_key"], "left")
    p_hit, p_miss, p_out = (
        F.coalesce(F.col(c), classes.fallback_price(F.col("provider"), F.col("model"), i))
        for i, c in enumerate(["p_hit", "p_miss", "p_out"])
    )
    cost = (
        F.col("cache_hit_tokens") * p_hit + F.col("cache_miss_tokens") * p_miss + F.col("completion_tokens") * p_out
    ) / F.lit(1_000_000).cast("decimal(7,0)")
    return out.withColumn("cost", cost.cast("decimal(24,10)")).withColumn(
        "currency", classes.provider_currency(F.col("provider"))
    ).drop("model_key", "p_hit", "p_miss", "p_out")


def backfill_type(details: DataFrame, items: DataFrame) -> DataFrame:
    """Type from the detail row, else from the item at the same position, else mcq."""
    own = items.select("ordinal", F.col("type").alias("_item_type"))
    out = details.join(own, "ordinal", "left")
    return out.withColumn("type", F.coalesce(F.nullif("type", F.lit("")), "_item_type", F.lit("mcq"))).drop("_item_type")


def filter_plan(
    plan: DataFrame, difficulties: Sequence[str] = (), types: Sequence[str] = (), failed: DataFrame | None = None,
    weak: DataFrame | None = None,
) -> DataFrame:
    """Keep the wanted difficulties and types, failed keys (short or long standards) and weak combos."""
    out = plan
    wanted = [x.strip().lower() for x in difficulties if x.strip().lower() in V.DIFFICULTIES]
    if wanted:
        out = out.filter(F.col("difficulty").isin(wanted))
    if types:
        out = out.filter(F.col("type").isin(list(types)))
    if failed is not None:
        keys = failed.select(
            short_standard(F.col("standard")).alias("_short"), "difficulty", F.coalesce("type", F.lit("fill-in")).alias("type")
        ).distinct()
        out = out.withColumn("_short", short_standard(F.col("standard")))
        out = out.join(keys, ["_short", "difficulty", "type"], "left_semi").drop("_short")
    if weak is not None:
        out = out.join(weak.select("type", "difficulty").distinct(), ["type", "difficulty"], "left_semi")
    return out


# ---- sets -------------------------------------------------------------------
def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all sources; a missing column is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def keys_in_both(a: DataFrame, b: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def keys_only_in_first(a: DataFrame, b: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def distinct_keys(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return df.select(*keys).distinct()
