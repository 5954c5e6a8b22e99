"""Aggregations over scored rows, samples, usage and failures.

Averages are sums of DECIMAL(18,6): exact, and the same in any task order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark import skew
from itemspark.functions import classes
from itemspark.functions import fixed_values as V
from itemspark.functions.curriculum import grade_rank, stored_grade


def _count(name: str, cond: Column | None = None) -> Column:
    return (F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name)


def percent(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when(whole > 0, F.round((part * 100).cast("double") / whole, digits))


def mean(total: str, n: str, digits: int) -> Column:
    return F.when(F.col(n) > 0, F.round(F.col(total).cast("double") / F.col(n), digits))


def _exact_sum(col: Column) -> Column:
    return F.sum(col.cast("decimal(18,6)"))


# ---- score break-downs ------------------------------------------------------
def score_breakdown(
    df: DataFrame, by: Sequence[str] = ("type", "difficulty"), score: str = "score", passing: float = V.PASS_SCORE,
    within: Sequence[str] = (),
) -> DataFrame:
    """Counts, pass rate and mean score by each key alone and by both, scored rows only.

    Rows are aggregated once on all keys; the grouping sets then run on the few
    aggregated rows instead of a three-fold copy of the input.
    """
    first, second = by
    fine = (
        df.filter(F.col(score).isNotNull())
        .withColumn(first, F.coalesce(first, F.lit("mcq")))
        .withColumn(second, F.coalesce(second, F.lit("medium")))
        .groupBy(*within, first, second)
        .agg(_count("n"), _count("p", F.col(score) >= passing), _exact_sum(F.col(score)).alias("s"))
    )
    sets = [[*map(F.col, within), *map(F.col, keys)] for keys in ([first], [second], [first, second])]
    grouped = fine.groupingSets(sets, *within, first, second).agg(
        F.sum("n").alias("count"), F.sum("p").alias("pass_count"), F.sum("s").alias("s"),
        F.grouping(first).alias("_g1"), F.grouping(second).alias("_g2"),
    )
    level = F.when(F.col("_g2") == 1, f"by_{first}").when(F.col("_g1") == 1, f"by_{second}").otherwise(
        f"by_{first}_{second}"
    )
    return grouped.select(
        *within, level.alias("level"), first, second, "count", "pass_count",
        percent("pass_count", "count").alias("pass_rate"), mean("s", "count", 4).alias("avg_score"),
    )


def evaluation_summary(
    df: DataFrame, by: Sequence[str] = (), score: str = "score", passing: float = V.PASS_SCORE,
    errors_as_zero: bool = False,
) -> DataFrame:
    """Submitted, valid and error counts and the three pass-rate definitions."""
    s = F.coalesce(F.col(score), F.lit(0.0)) if errors_as_zero else F.col(score)
    got = df.withColumn("_s", s).groupBy(*by).agg(
        _count("n_submitted"), F.count("_s").alias("n_valid"), _count("pass_count", F.col("_s") >= passing),
        _exact_sum(F.col("_s")).alias("_sum"),
    )
    return got.select(
        *by, "n_submitted", "n_valid", (F.col("n_submitted") - F.col("n_valid")).alias("n_error"), "pass_count",
        mean("_sum", "n_valid", 2).alias("avg_score"), percent("pass_count", "n_valid", 2).alias("pass_rate"),
        percent("pass_count", "n_submitted", 2).alias("pass_rate_if_errors_as_fail"),
    )


def error_details(df: DataFrame, message: str = "message", score: str = "score") -> DataFrame:
    """Unscored rows with their reason and who is to blame."""
    reason = F.coalesce(F.nullif(F.col(message), F.lit("")), F.lit("unknown"))
    return df.filter(F.col(score).isNull()).withColumn("reason", reason).withColumn("blame", classes.blame(reason))


# ---- dimensions -------------------------------------------------------------
def dimension_counts(df: DataFrame, dims: Sequence[str] = ("difficulty", "standard", "subject")) -> DataFrame:
    """Long table (dimension, value, n) for every dimension and for the whole."""
    fine = df.groupBy(*dims).agg(_count("n"))
    sets = [[F.col(d)] for d in dims] + [[]]
    out = fine.groupingSets(sets, *dims).agg(
        F.sum("n").alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n")


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    return df.groupBy(col).agg(_count("n")).orderBy(F.desc("n"), col).limit(k)


def curriculum_dimensions(standards: DataFrame, grade: str, subject: str) -> DataFrame:
    """Every (standard, difficulty) pair of a grade and subject."""
    wanted = V.GRADE_ALIASES.get(grade, grade)
    own = standards.filter((F.col("grade") == wanted) & (F.col("subject_abbr") == subject))
    levels = F.explode(F.array(*map(F.lit, V.DIFFICULTIES))).alias("difficulty")
    return own.select("standard_id").distinct().select(
        F.col("standard_id").alias("standard"), levels
    ).withColumn("subject", F.lit(subject))


# ---- length profile ---------------------------------------------------------
def length_summary(df: DataFrame, role: str = "role", length: str = "n_tokens") -> DataFrame:
    """Min, p50, p95, max and mean length per role; percentiles are list positions.

    The value at list position ``min(n * p div 100, n - 1)`` is found from the
    counts per distinct length, so the sorted list itself never exists.
    """
    from pyspark.sql import Window as W

    sizes = df.groupBy(role, length).agg(_count("n"))
    upto = W.partitionBy(role).orderBy(length).rowsBetween(W.unboundedPreceding, 0)
    ranked = sizes.withColumn("_hi", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(W.partitionBy(role)))

    def at(p: int) -> Column:
        position = F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)
        inside = (F.col("_hi") > position) & (F.col("_hi") - F.col("n") <= position)
        return F.max(F.when(inside, F.col(length)))

    out = ranked.groupBy(role).agg(
        F.sum("n").alias("n_rows"), F.min(length).alias("min_len"), at(50).alias("p50"), at(95).alias("p95"),
        F.max(length).alias("max_len"), F.sum(F.col(length) * F.col("n")).alias("_sum"),
    )
    return out.withColumn("mean_len", mean("_sum", "n_rows", 4)).drop("_sum")


def approx_length_summary(df: DataFrame, role: str = "role", length: str = "n_tokens") -> DataFrame:
    """Approximate percentiles in one pass, for when exact ones are not needed."""
    return df.groupBy(role).agg(
        _count("n_rows"), F.percentile_approx(length, F.lit(0.5), 10000).alias("p50"),
        F.percentile_approx(length, F.lit(0.95), 10000).alias("p95"),
    )


# ---- failures ---------------------------------------------------------------
def failure_counts(
    df: DataFrame, dims: Sequence[str] = ("reason", "model", "difficulty", "standard"), top: int | None = None
) -> DataFrame:
    """Counts of all values of each dimension, or of the ``top`` most frequent, name order breaking ties."""
    fine = df.select(*[F.coalesce(d, F.lit("?")).alias(d) for d in dims]).groupBy(*dims).agg(_count("n"))
    entries = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    counts = fine.select(entries.alias("e"), "n").groupBy("e.dimension", "e.value").agg(F.sum("n").alias("n"))
    return counts if top is None else skew.top_rows(counts, ["dimension"], ["-n", "value"], top)


def log_error_counts(lines: DataFrame, file: str = "file", text: str = "line") -> DataFrame:
    """First matching error class per line; counts per file and class, per file, and overall."""
    classed = lines.select(file, classes.log_class(F.col(text)).alias("error_class")).filter("error_class is not null")
    fine = classed.groupBy(file, "error_class").agg(_count("n"))
    sets = [[F.col(file), F.col("error_class")], [F.col("error_class")], [F.col(file)]]
    return (
        fine.groupingSets(sets, file, "error_class")
        .agg(F.sum("n").alias("n"), F.grouping(file).alias("_gf"), F.grouping("error_class").alias("_gc"))
        .select(
            F.when(F.col("_gf") == 1, "by_class").when(F.col("_gc") == 1, "by_file").otherwise("by_file_class").alias(
                "level"
            ),
            file, "error_class", "n",
        )
    )


def suggested_fixes(
    failures: DataFrame, reason: str = "reason", fixes: Sequence[tuple[str, str]] = tuple(V.KNOWN_FIXES), at_least: int = 3
) -> DataFrame:
    """First known fix whose key occurs in the reason; frequent unknown reasons ask for a look."""
    counts = failures.groupBy(reason).agg(_count("n"))
    key = F.replace(F.lower(reason), F.lit(" "), F.lit("_"))
    fix = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, advice in fixes:
        fix = fix.when(F.contains(key, F.lit(name)), advice)
    fix = fix.when(F.col("n") >= at_least, V.UNKNOWN_FIX)
    return counts.withColumn("fix", fix).filter("fix is not null")


def log_class_fixes(class_counts: DataFrame, fixes: Sequence[tuple[str, str]] = tuple(V.KNOWN_FIXES)) -> DataFrame:
    """Known fixes for the error classes found in logs; ``class_counts`` has error_class and n."""
    fix = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, advice in fixes:
        fix = fix.when(F.col("error_class") == name, advice)
    return class_counts.select("error_class", "n", fix.alias("fix")).filter("fix is not null")


def failure_summary(failures: DataFrame, reason: str = "reason") -> DataFrame:
    """Counts by the whole reason; null and blank ones are ``unknown``."""
    short = F.coalesce(F.nullif(reason, F.lit("")), F.lit("unknown"))
    return failures.groupBy(short.alias("short_reason")).agg(_count("n")).orderBy(F.desc("n"), "short_reason")


def repeated_failures(failures: DataFrame, at_least: int = 3) -> DataFrame:
    """Keys failing often, with their main reason (name order breaks ties)."""
    fine = failures.groupBy("standard", "difficulty", "reason").agg(_count("n"))
    main = F.min(F.struct((-F.col("n")).alias("neg"), F.col("reason").alias("reason")))
    return (
        fine.groupBy("standard", "difficulty")
        .agg(F.sum("n").alias("n_failures"), main.alias("m"))
        .filter(F.col("n_failures") >= at_least)
        .select(
            "standard", "difficulty", "n_failures", F.col("m.reason").alias("top_reason"), (-F.col("m.neg")).alias("top_count")
        )
    )


# ---- weak spots -------------------------------------------------------------
def weak_combos(df: DataFrame, below: float, passing: float = V.PASS_SCORE) -> DataFrame:
    """(type, difficulty) pairs with a pass rate under ``below`` percent."""
    got = score_breakdown(df, passing=passing).filter("level = 'by_type_difficulty'")
    return got.filter(F.col("pass_rate") < below).select("type", "difficulty", "pass_rate")


def weak_combos_from_marginals(breakdown: DataFrame, below: float) -> DataFrame:
    """Estimate when only the marginal rates are known: their mean.

    The marginals are at most (types + difficulties) rows; each type is paired
    with the collected difficulty rates of the same break-down.
    """
    levels = breakdown.filter("level = 'by_difficulty'").agg(
        F.collect_list(F.struct("difficulty", "pass_rate")).alias("levels")
    )
    types = breakdown.filter("level = 'by_type'").select("type", F.col("pass_rate").alias("type_rate"))
    both = types.withColumn("d", F.explode(levels.scalar()))
    rate = (F.col("type_rate") + F.col("d.pass_rate")) / 2
    return both.select("type", F.col("d.difficulty").alias("difficulty"), rate.alias("pass_rate")).filter(
        F.col("pass_rate") < below
    )


def weak_item_counts(
    df: DataFrame, below: float = V.PASS_SCORE, missing_score: float | None = 1.0, score: str = "score"
) -> DataFrame:
    """Weak rows by type, difficulty and both; ``missing_score`` stands in for a null."""
    s = F.col(score) if missing_score is None else F.coalesce(F.col(score), F.lit(float(missing_score)))
    fine = df.filter(s < below).groupBy("type", "difficulty").agg(_count("n"))
    sets = [[F.col("type")], [F.col("difficulty")], [F.col("type"), F.col("difficulty")]]
    return (
        fine.groupingSets(sets, "type", "difficulty")
        .agg(F.sum("n").alias("n"), F.grouping("type").alias("_t"), F.grouping("difficulty").alias("_d"))
        .select(
            F.when(F.col("_d") == 1, "by_type").when(F.col("_t") == 1, "by_difficulty").otherwise(
                "by_type_difficulty"
            ).alias("level"),
            "type", "difficulty", "n",
        )
    )


# ---- matrices ---------------------------------------------------------------
def score_matrix(
    rates: DataFrame, grades: Sequence[str] = tuple(V.GRADE_COLUMNS), rate: str = "pass_rate", within: Sequence[str] = ()
) -> DataFrame:
    """Models down, grades across, and the mean of the grades present."""
    keys = ["model", *within]
    wide = rates.groupBy(*keys).pivot("grade", list(grades)).agg(F.max(rate))
    cells = [F.col(f"`{g}`") for g in grades]
    present = F.filter(F.array(*cells), lambda c: c.isNotNull())
    total = F.aggregate(
        present, F.lit(0).cast("decimal(18,6)"),
        lambda acc, c: (acc + c.cast("decimal(18,6)")).cast("decimal(18,6)"), lambda acc: acc.cast("double"),
    )
    average = F.when(F.size(present) > 0, F.round(total / F.size(present), 1))
    return wide.select(*keys, *[c.alias(f"g{g}") for c, g in zip(cells, grades)], average.alias("avg_rate"))


def breakdown_rates(df: DataFrame, within: Sequence[str] = ("model", "grade")) -> DataFrame:
    """Pass rates per model and grade: overall, by type, by difficulty, by both."""
    parts = score_breakdown(df, within=within).select(*within, "level", "type", "difficulty", "pass_rate")
    overall = evaluation_summary(df, by=within).select(
        *within, F.lit("overall").alias("level"), F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("difficulty"), percent("pass_count", "n_valid").alias("pass_rate"),
    )
    return overall.unionByName(parts)


def matrix_winners(rates: DataFrame, rate: str = "pass_rate") -> DataFrame:
    """Best model per grade; the first model name wins a tie."""
    best = F.min(F.struct((-F.col(rate)).alias("neg"), F.col("model").alias("model")))
    return rates.filter(F.col(rate).isNotNull()).groupBy("grade").agg(best.alias("b")).select(
        "grade", F.col("b.model").alias("model"), (-F.col("b.neg")).alias("best_rate")
    )


def model_ranking(matrix: DataFrame) -> DataFrame:
    """Rank of the models by their overall mean; a model without one counts as 0.

    One row per model reaches the ranking window.
    """
    from pyspark.sql import Window as W

    rate = F.coalesce("avg_rate", F.lit(0.0))
    order = W.orderBy(F.desc("avg_rate"), "model")
    return matrix.select("model", rate.alias("avg_rate")).withColumn("rank", F.row_number().over(order).cast("long"))


def curriculum_meta(standards: DataFrame) -> DataFrame:
    """Both ways between grades and subjects, numbers in number order."""
    pairs = standards.select("grade", "subject_abbr").distinct()
    by_grade = pairs.groupBy("grade").agg(F.array_sort(F.collect_set("subject_abbr")).alias("vals")).select(
        F.lit("grade").alias("side"), F.col("grade").alias("key"), "vals"
    )
    ranked = F.array_sort(F.collect_set(F.struct(grade_rank(F.col("grade")).alias("r"), F.col("grade").alias("g"))))
    by_subject = pairs.groupBy("subject_abbr").agg(ranked.alias("v")).select(
        F.lit("subject").alias("side"), F.col("subject_abbr").alias("key"), F.transform("v", lambda x: x["g"]).alias("vals")
    )
    return by_grade.unionByName(by_subject).withColumn("n_values", F.size("vals").cast("long"))


# ---- usage ------------------------------------------------------------------
def usage_totals(calls: DataFrame, by: Sequence[str] = ("model",), valid: str | None = None) -> DataFrame:
    """Token sums and cost; mean tokens per valid item when ``valid`` names its flag."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    n_items = F.count_if(F.col(valid)) if valid else F.count(F.lit(1))
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_hit_tokens", "cache_miss_tokens")]
    got = calls.groupBy(*by).agg(
        _count("calls"), *sums, F.sum("cost").alias("cost"), n_items.alias("n_items"), F.sum(total).alias("_t")
    )
    return got.withColumn("tokens_per_item", mean("_t", "n_items", 1)).drop("_t")


def round_log_summary(rounds: DataFrame, by: Sequence[str] = ("model", "grade")) -> DataFrame:
    """Rounds, mean pass rate, best rate with its first round, and cost per currency.

    A round without a scored item has no rate and cannot be the best.
    """
    rated = F.struct((-F.col("pass_rate")).alias("neg"), F.col("round").alias("round"))
    best = F.min(F.when(F.col("pass_rate").isNotNull(), rated))
    money = [
        F.coalesce(_exact_sum(F.when(F.col("currency") == code, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias(
            f"cost_{code.lower()}"
        )
        for code in ("USD", "CNY")
    ]
    got = rounds.groupBy(*by).agg(
        _count("n_rounds"), F.count("pass_rate").alias("_n"), _exact_sum(F.col("pass_rate")).alias("_s"), best.alias("b"),
        F.sum("elapsed_s").alias("elapsed_s"), *money,
    )
    return got.select(
        *by, "n_rounds", mean("_s", "_n", 2).alias("average_pass_rate"), (-F.col("b.neg")).alias("best_pass_rate"),
        F.col("b.round").alias("best_round"), "cost_usd", "cost_cny",
        F.expr("elapsed_s div 3600").alias("elapsed_h"), F.expr("(elapsed_s % 3600) div 60").alias("elapsed_m"),
    )


def multi_model_summary(rounds: DataFrame, target: float, by: Sequence[str] = ("model",)) -> DataFrame:
    """Final and best rate, whether the target was met, and the counts of the last round."""
    last = F.max_by(F.struct("pass_rate", "pass_count", "n_valid", "n_submitted"), F.col("round"))
    got = rounds.groupBy(*by).agg(
        F.max("round").alias("round_reached"), last.alias("l"), F.max("pass_rate").alias("best_pass_rate")
    )
    return got.select(
        *by, "round_reached", F.col("l.pass_rate").alias("final_pass_rate"), "best_pass_rate",
        (F.col("best_pass_rate") >= target).alias("target_reached"), F.col("l.pass_count").alias("pass_count"),
        F.col("l.n_valid").alias("n_valid"), F.col("l.n_submitted").alias("n_submitted"),
    )


def cycle_report(cycles: DataFrame, by: Sequence[str] = ("grade",)) -> DataFrame:
    """First-round pass rate of all cycles in order (``first_rates``), their mean, the trend, and repair rounds.

    A first round without a rate is null there and left out of the mean; the
    trend is null when the first or the last cycle has no first-round rate.
    """
    first = cycles.groupBy(*by, "cycle").agg(
        F.min_by("pass_rate", "inner_round").alias("first_rate"), (F.max("inner_round") - 1).alias("repairs")
    )
    out = first.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("cycle", "first_rate"))).alias("first_rates"),
        F.count("first_rate").alias("_n"), _exact_sum(F.col("first_rate")).alias("_s"),
        F.min_by("first_rate", "cycle").alias("_f"), F.max_by("first_rate", "cycle").alias("_l"),
        F.sum("repairs").alias("repair_rounds"), _count("n_cycles"),
    )
    return out.select(
        *by, "first_rates", mean("_s", "_n", 1).alias("mean_rate"),
        F.round(F.col("_l") - F.col("_f"), 1).alias("trend"), "repair_rounds", "n_cycles",
    )


# ---- rubric dimensions ------------------------------------------------------
def dimension_failures(result_dims: DataFrame, passing: float = V.PASS_SCORE) -> DataFrame:
    """Low rubric dimensions of low items; rows are (key, eval_pos, dim, score) of the first evaluation."""
    first = result_dims.filter(F.col("eval_pos") == 0)
    low = first.filter((F.col("item_score").isNull() | (F.col("item_score") < passing)) & (F.col("dim") != "overall"))
    return low.filter(F.col("score") < passing)


def item_score(evaluations: DataFrame, keys: Sequence[str], how: str = "mean") -> DataFrame:
    """Item score over several evaluations: their mean, or the first one found."""
    scored = evaluations.filter("dim = 'overall' and score is not null")
    if how == "mean":
        got = scored.groupBy(*keys).agg(_exact_sum(F.col("score")).alias("_s"), _count("_n"))
        return got.select(*keys, mean("_s", "_n", 6).alias("score"))
    return scored.groupBy(*keys).agg(F.min_by("score", "eval_pos").alias("score"))


# ---- corpus profiles --------------------------------------------------------
def plan_coverage(plan: DataFrame, incoming: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming and current row counts per plan key, and whether it has none at all."""
    new = incoming.groupBy(*keys).agg(_count("n_incoming"))
    old = current.groupBy(*keys).agg(_count("n_current"))
    out = plan.select(*keys).distinct().join(new, list(keys), "left").join(old, list(keys), "left")
    out = out.fillna(0, ["n_incoming", "n_current"])
    return out.withColumn("uncovered", (F.col("n_incoming") == 0) & (F.col("n_current") == 0))


def grade_subject_reason(df: DataFrame, standards: DataFrame) -> DataFrame:
    """Why a (grade, subject) pair is not served; null when it is.

    Grades and subjects come from the curriculum; the three key sets are
    distinct values, joined without a hint so that their size decides.
    """
    pairs = standards.select(F.col("grade").alias("_grade"), F.col("subject_abbr").alias("subject")).distinct()
    grades = pairs.select("_grade").distinct().withColumn("_has_grade", F.lit(True))
    subjects = pairs.select("subject").distinct().withColumn("_has_subject", F.lit(True))
    out = (
        df.withColumn("_grade", stored_grade(F.col("grade")))
        .join(grades, "_grade", "left").join(subjects, "subject", "left")
        .join(pairs.withColumn("_has_pair", F.lit(True)), ["_grade", "subject"], "left")
    )
    reason = (
        F.when(F.col("_has_grade").isNull(), "unknown_grade").when(F.col("_has_subject").isNull(), "unknown_subject")
        .when(F.col("_has_pair").isNull(), "unknown_pair")
    )
    return out.withColumn("reason", reason).select(*df.columns, "reason")
