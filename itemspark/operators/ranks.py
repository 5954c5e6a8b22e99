"""Ranking, top-k, numbering, streaks and round tracking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark import skew
from itemspark.functions import fixed_values as V
from itemspark.functions.text import seeded_order
from itemspark.session import durable

KEY = ("standard", "difficulty", "type")


def top_k_per_key(
    df: DataFrame, keys: Sequence[str] = KEY, k: int = 1, min_score: float | None = V.PASS_SCORE,
    score: str = "score", ordinal: str = "ordinal",
) -> DataFrame:
    """Best ``k`` rows per key; input order breaks ties."""
    kept = df if min_score is None else df.filter(F.col(score) >= min_score)
    return skew.top_rows(kept, keys, [f"-{score}", ordinal], k, out="rank")


def select_diverse(
    df: DataFrame, n: int, keys: Sequence[str] = ("standard", "difficulty"), score: str = "score", ordinal: str = "ordinal"
) -> DataFrame:
    """``n`` rows: first the best of every key, then the best of the rest, equal rows once."""
    content = [c for c in df.columns if c != ordinal]
    once = df.groupBy(*content).agg(F.min(ordinal).alias(ordinal))
    ranked = skew.top_rows(once, keys, [f"-{score}", ordinal], n, out="_rank")
    chosen = ranked.orderBy((F.col("_rank") > 1).asc(), F.desc(score), F.asc(ordinal)).limit(n)
    return chosen.select(*df.columns)


def diverse_plan(keys: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """Up to ``n`` (standard, difficulty) pairs, turning through easy, medium and hard.

    The pairs of a difficulty come in a seeded order that is a function of the
    pair alone. Other difficulties only fill up. ``n = None`` takes every pair.
    """
    pairs = keys.select("standard", "difficulty").distinct().filter("standard <> 'unknown'")
    if n is None:
        return pairs
    level = F.array_position(F.array(*map(F.lit, V.DIFFICULTIES)), F.col("difficulty"))
    drawn = pairs.withColumn("_level", F.when(level == 0, 99).otherwise(level)).withColumn(
        "_draw", seeded_order(seed, F.col("standard"), F.col("difficulty"))
    )
    turns = skew.top_rows(drawn, ["_level"], ["_draw", "standard", "difficulty"], n, out="_turn")
    order = [F.col("_level") == 99, F.col("_turn"), F.col("_level")]
    return turns.orderBy(*order).limit(n).select("standard", "difficulty")


def first_passing_candidate(
    df: DataFrame, keys: Sequence[str] = ("standard", "difficulty"), passing: float = V.PASS_SCORE
) -> DataFrame:
    """Scan the candidates of a key in order up to the first that passes.

    ``evaluated`` counts the candidates looked at, ``saved`` those after it.
    """
    good = F.col("score") >= passing
    first = df.groupBy(*keys).agg(
        F.min(F.when(good, F.struct("ordinal", "score"))).alias("_win"), F.count(F.lit(1)).alias("n_candidates")
    )
    looked_at = F.col("_win").isNull() | (F.col("ordinal") <= F.col("_win.ordinal"))
    spread = skew.salted_lookup(df.select(*keys, "ordinal"), first, keys, salt_on="ordinal")
    return (
        spread.groupBy(*keys)
        .agg(F.first("_win").alias("_win"), F.first("n_candidates").alias("n_candidates"), F.count_if(looked_at).alias("evaluated"))
        .select(
            *keys, "n_candidates", "evaluated", (F.col("n_candidates") - F.col("evaluated")).alias("saved"),
            F.col("_win.ordinal").alias("winner"), F.col("_win.score").alias("winner_score"),
        )
    )


def batch_high_scorers(
    rows: DataFrame, failed: DataFrame, keys: Sequence[str] = ("standard", "difficulty"), passing: float = V.PASS_SCORE
) -> DataFrame:
    """Best passing row of every failed key."""
    own = rows.filter(F.col("score") >= passing).join(failed.select(*keys).distinct(), list(keys), "left_semi")
    return top_k_per_key(own, keys, 1, None).drop("rank")


def best_fallback(
    rows: DataFrame, keys_without: DataFrame, keys: Sequence[str] = ("standard", "difficulty"), floor: float = V.PASS_SCORE
) -> DataFrame:
    """Best row of the given keys, an unscored row counting as 0, if it reaches the floor."""
    own = rows.withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = own.join(keys_without.select(*keys).distinct(), list(keys), "left_semi")
    return top_k_per_key(own, keys, 1, None).drop("rank").filter(F.col("score") >= floor)


def progress_track(
    rounds: DataFrame, patience: int, target: float, by: Sequence[str] = ("model", "grade")
) -> DataFrame:
    """Running best, rounds without improvement, and where the loop ends.

    Input has one row per (by, round), so a window holds the rounds of one run.
    ``end_round`` is the first round that meets the target or exhausts the
    patience (never the last round for the latter), else the last round.
    """
    run = W.partitionBy(*by).orderBy("round")
    before, upto = run.rowsBetween(W.unboundedPreceding, -1), run.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    scored = rounds.filter("pass_rate is not null")
    out = (
        scored.withColumn("improved", F.col("pass_rate") > F.coalesce(F.max("pass_rate").over(before), F.lit(-1.0)))
        .withColumn("best_pass_rate", F.max("pass_rate").over(upto))
        .withColumn("best_round", F.max(F.when(F.col("improved"), F.col("round"))).over(upto))
        .withColumn("_i", F.row_number().over(run).cast("long"))
        .withColumn("_best_i", F.max(F.when(F.col("improved"), F.col("_i"))).over(upto))
        .withColumn("since_best", F.col("_i") - F.col("_best_i"))
        .withColumn("_last", F.max("round").over(whole))
    )
    met = (F.col("pass_rate") >= target) if target > 0 else F.lit(False)
    tired = (F.col("since_best") >= patience) & (F.col("round") < F.col("_last")) if patience > 0 else F.lit(False)
    end = F.coalesce(F.min(F.when(met | tired, F.col("round"))).over(whole), F.col("_last"))
    return (
        out.withColumn("end_round", end).withColumn("target_met", met).filter(F.col("round") <= F.col("end_round"))
        .select(*by, "round", "pass_rate", "improved", "best_pass_rate", "best_round", "since_best", "target_met", "end_round")
    )


def cycle_track(
    rounds: DataFrame, max_inner: int, n_cycles: int | None = None, by: Sequence[str] = ("model", "grade")
) -> DataFrame:
    """Cycle and inner round of every round; a cycle ends when nothing fails or after ``max_inner`` rounds.

    Stretches between all-pass rounds are found first and then cut into
    blocks of ``max_inner``. Input has one row per (by, round).
    """
    run = W.partitionBy(*by).orderBy("round")
    before = run.rowsBetween(W.unboundedPreceding, -1)
    clean = (F.col("n_valid") > 0) & (F.col("n_fail") == 0)
    out = rounds.withColumn("all_passed", clean)
    out = out.withColumn("_stretch", F.coalesce(F.sum(F.col("all_passed").cast("long")).over(before), F.lit(0)))
    inside = F.row_number().over(W.partitionBy(*by, "_stretch").orderBy("round"))
    out = out.withColumn("inner_round", ((inside - 1) % max_inner + 1).cast("long"))
    ended = F.col("all_passed") | (F.col("inner_round") == max_inner)
    out = out.withColumn("_end", ended)
    out = out.withColumn("cycle", F.coalesce(F.sum(F.col("_end").cast("long")).over(before), F.lit(0)) + 1)
    out = out.select(*by, "round", "pass_rate", "cycle", "inner_round", "all_passed")
    return out if n_cycles is None else out.filter(F.col("cycle") <= n_cycles)


def failing_streaks(
    df: DataFrame, min_streak: int = 3, passing: float = V.PASS_SCORE, keys: Sequence[str] = KEY, ordinal: str = "ordinal"
) -> DataFrame:
    """Keys whose newest rows fail ``min_streak`` times or more, with their last scores.

    Unscored rows are left out. The newest pass is one row per key; rows after it
    are counted through a salted join, so a hot key is shared by many tasks.
    """
    scored = df.filter(F.col("score").isNotNull()).select(*keys, ordinal, "score")
    last_pass = scored.groupBy(*keys).agg(F.max(F.when(F.col("score") >= passing, F.col(ordinal))).alias("_pass"))
    low = scored.filter(F.col("score") < passing)
    tail = skew.salted_lookup(low, last_pass, keys, salt_on=ordinal).filter(
        F.col("_pass").isNull() | (F.col(ordinal) > F.col("_pass"))
    )
    streaks = tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("streak")).filter(F.col("streak") >= min_streak)
    newest = skew.top_rows(scored, keys, [f"-{ordinal}"], min_streak)
    recent = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.round("score", 2).alias("s"))))
    scores = newest.groupBy(*keys).agg(F.transform(recent, lambda x: x["s"]).alias("last_scores"))
    return streaks.join(scores, list(keys))


def renumber(df: DataFrame, order: Sequence[str], id_col: str = "id", prefix: str = "diverse_") -> DataFrame:
    """Dense ids ``diverse_000``, ``diverse_001``, ... in the given order."""
    out = skew.dense_number(df, order, "_n")
    digits = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return out.withColumn(id_col, F.concat(F.lit(prefix), digits)).drop("_n")


def best_run_per_model_grade(runs: DataFrame, by: Sequence[str] = ("model", "grade"), name: str = "file") -> DataFrame:
    """File with the highest pass rate; the first name wins ties, unreadable files count as -1."""
    rate = F.coalesce("pass_rate", F.lit(-1.0))
    best = F.min(F.struct((-rate).alias("neg"), F.col(name).alias("name")))
    return runs.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.name").alias(name), (-F.col("b.neg")).alias("pass_rate"))


def rate_limit_alerts(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", window_s: int = 60, at_least: int = 3, cooldown_s: int = 30
) -> DataFrame:
    """Events that see ``at_least`` events of their key in the trailing window, and the pause they start.

    A key is cut into stretches of ten windows; the last ``window_s`` seconds of a
    stretch are also handed to the next one, so every frame is complete and no
    task holds a whole key.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    span = window_s * 1_000_000
    step = 10 * span
    timed = events.withColumn("_us", micros).withColumn("_own", F.floor(F.col("_us") / step))
    late = F.floor((F.col("_us") + span) / step)
    spread = timed.withColumn("_part", F.explode(F.sequence(F.col("_own"), late)))
    frame = W.partitionBy(*keys, "_part").orderBy("_us").rangeBetween(-span, 0)
    counted = spread.withColumn("n_recent", F.count(F.lit(1)).over(frame)).filter(F.col("_part") == F.col("_own"))
    paused = F.col(ts) + F.make_interval(secs=F.lit(cooldown_s))
    return counted.filter(F.col("n_recent") >= at_least).withColumn("cooldown_until", paused).select(
        *events.columns, "n_recent", "cooldown_until"
    )


def after_cooldown(alerts: DataFrame, keys: Sequence[str], ts: str = "ts", cooldown_s: int = 30, order: Sequence[str] = ("event_id",)) -> DataFrame:
    """The alerts that are raised when each one silences its key until ``cooldown_s`` later.

    Of alerts at one moment the first by ``order`` counts. An alert at least the
    pause after the one before it is always raised and starts a chain; in a
    chain, the next raised alert is the first one after the pause. Chains are
    followed by pointer doubling: a round reaches twice as far as all before it,
    so a key's alerts are never walked in one task. Neighbours in time are found
    in stretches of a key that overlap by two pauses.
    """
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    pause = cooldown_s * 1_000_000
    step = max(100 * pause, 1)
    named = alerts.withColumn("_us", us)
    moments = named.filter(F.col(ts).isNotNull()).select(*keys, "_us").distinct()
    own = F.floor(F.col("_us") / step)
    ends = F.sequence(F.floor((F.col("_us") - 2 * pause) / step), F.floor((F.col("_us") + 2 * pause) / step))
    spread = moments.withColumn("_part", F.explode(ends))
    place = W.partitionBy(*keys, "_part").orderBy("_us")
    before = F.max("_us").over(place.rangeBetween(-pause + 1, -1)) if pause > 1 else F.lit(None).cast("long")
    after = F.min("_us").over(place.rangeBetween(max(pause, 1), 2 * max(pause, 1)))
    linked = spread.withColumns({"_before": before, "_next": after}).filter(F.col("_part") == own)
    nodes = durable(linked.select(*keys, "_us", F.col("_before").isNull().alias("_head"), "_next"))
    reached = nodes.filter("_head").select(*keys, "_us")
    jumps = nodes.filter("_next IS NOT NULL").select(*keys, "_us", "_next")
    while True:
        told = reached.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_us").alias("_at"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        landed = jumps.join(told, [*same, F.col("_us") == F.col("_at")], "left_semi").select(*keys, F.col("_next").alias("_us"))
        wider = durable(reached.unionByName(landed).distinct())
        if wider.count() == reached.count():
            break
        reached = wider
        further = jumps.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_us").alias("_at"), F.col("_next").alias("_then"))
        jumps = durable(jumps.join(further, [*same, F.col("_next") == F.col("_at")]).select(*keys, "_us", F.col("_then").alias("_next")))
    first = named.groupBy(*keys, "_us").agg(F.min(F.struct(*order)).alias("_first"))
    raised = reached.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_us").alias("_at"))
    chosen = first.join(raised, [*same, F.col("_us") == F.col("_at")], "left_semi")
    chosen = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_us").alias("_at"), "_first")
    out = named.join(chosen, [*same, F.col("_us") == F.col("_at"), F.struct(*order).eqNullSafe(F.col("_first"))], "left_semi")
    return out.select(*alerts.columns)


def recent_n(df: DataFrame, n: int = 10, order: Sequence[str] = ("-ts", "-event_id")) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(*skew.ordering(order)).limit(n)


def dedupe_standards(
    blocks: DataFrame, key: str = "standard_id", pos: str = "pos", lists: Sequence[str] = ("objective", "misconception")
) -> DataFrame:
    """First block per standard; empty fields come from the first later block that has them."""
    plain = [c for c in blocks.columns if c not in (key, pos, *lists)]

    def filled(c: str):
        kind = blocks.schema[c].dataType.typeName()
        has = (F.size(c) > 0) if kind == "array" else F.col(c).isNotNull()
        return F.min_by(F.col(c), F.when(has, F.col(pos))).alias(c)

    first = F.min_by(F.struct(*plain), F.col(pos)).alias("_f")
    return blocks.groupBy(key).agg(first, F.min(pos).alias(pos), *map(filled, lists)).select(
        key, pos, *[F.col(f"_f.{c}").alias(c) for c in plain], *lists
    )


def recover_best(runs: DataFrame, by: Sequence[str] = ("model", "grade"), name: str = "file") -> DataFrame:
    """Best run per key and the rate label it is kept under."""
    best = best_run_per_model_grade(runs, by, name)
    label = F.replace(F.round("pass_rate", 1).cast("string"), F.lit("."), F.lit("_"))
    return best.withColumn("rate_label", label)
