"""One round of the loop: responses -> items -> scores -> break-down, failures and new rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V
from itemspark.operators import aggs, joins, mend, parse, ranks, rules
from itemspark.operators.score import Scorer, score_items
from itemspark.session import durable

_RULES = "scope string, standard string, difficulty string, type string, pos long, rule string"


def items_for_plan(plan: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one valid item per plan row, failure table). ``responses`` has plan_pos, model and response."""
    asked = plan.select("plan_pos", "standard", "difficulty", F.col("type").alias("expected_type"))
    parsed = parse.parse_responses(
        asked.join(responses, "plan_pos"), context={"standard": "standard", "difficulty": "difficulty"}
    )
    good = parse.usable(parsed).select(F.col("plan_pos").alias("ordinal"), "item.*")
    return mend.complete_plan(plan, good), parse.failure_table(parsed)


_ITEM = ["ordinal", "plan_pos", "id", "type", "standard", "difficulty", "question", "answer", "answer_options", "acceptable_answers", "answer_explanation", "outcome"]


def _completed(items: DataFrame, best: DataFrame | None, cached: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(items with those of the best run for keys that this round did not redo, scores that need not be asked for again)."""
    if best is None:
        return items, cached
    merged = joins.merge_partial_run(best.select(*_ITEM, "score"), items.select(*_ITEM))
    known = merged.filter("NOT to_score").select("ordinal", "score")
    if cached is not None:
        known = known.unionByName(cached.select("ordinal", "score").join(known, "ordinal", "left_anti"))
    return merged.select(*_ITEM), durable(known)


def _feedback(scored: DataFrame, dims: DataFrame | None) -> DataFrame:
    """What was said about low items: their low rubric dimensions where there are any, else the scorer's message."""
    none = F.lit(None).cast("string")
    if dims is None:
        told = scored.withColumns({"suggestion": none, "reasoning": F.col("message"), "internal_reasoning": none})
        return rules.failure_feedback(told)
    low = aggs.dimension_failures(dims.join(scored.select("ordinal", F.col("score").alias("item_score")), "ordinal"))
    named = F.array_sort(F.collect_list(F.struct("dim", "reasoning", "suggestion")))
    said = low.groupBy("ordinal").agg(named.alias("d")).select(
        "ordinal", F.nullif(F.array_join(F.transform("d", lambda x: x["reasoning"]), " "), F.lit("")).alias("reasoning"),
        F.nullif(F.array_join(F.transform("d", lambda x: x["suggestion"]), " "), F.lit("")).alias("suggestion"),
    )
    told = scored.join(said, "ordinal", "left").withColumn("reasoning", F.coalesce("reasoning", "message"))
    return rules.failure_feedback(told.withColumn("internal_reasoning", none))


def _new_rules(feedback: DataFrame, themes: Sequence[rules.Theme], dims: DataFrame | None, dim_themes: dict[str, Sequence[rules.Theme]]) -> DataFrame:
    none = F.lit(None).cast("string")
    place = [F.lit("global").alias("scope"), none.alias("standard"), none.alias("difficulty"), none.alias("type")]
    new = rules.theme_rules(feedback, themes).select(*place, "pos", "rule").unionByName(rules.keyed_rules(feedback))
    if dims is None or not dim_themes:
        return new
    low = dims.filter((F.col("eval_pos") == 0) & (F.col("score") < V.PASS_SCORE))
    by_dim = rules.dimension_theme_rules(low, dim_themes)
    return new.unionByName(by_dim.select(*place, (F.col("pos") + len(themes)).alias("pos"), "rule"))


def close_round(
    plan: DataFrame, responses: DataFrame, scorer: Scorer, cached: DataFrame | None = None, themes: Sequence[rules.Theme] = (),
    stored_rules: DataFrame | None = None, round_no: int = 1, best: DataFrame | None = None, history: DataFrame | None = None,
    negatives: DataFrame | None = None, dims: DataFrame | None = None, dim_themes: dict[str, Sequence[rules.Theme]] | None = None,
    min_streak: int = 3, patience: int = 0, target: float = 0.0,
) -> dict[str, DataFrame]:
    """Everything a round leaves behind; items and scores are written once and then reused.

    ``best`` (items with ``score``) completes a round over a part of the plan, whose
    other keys keep their items and scores. ``history`` (``round``, ``ordinal``,
    key, ``score``) and ``negatives`` come from earlier rounds: keys that failed
    ``min_streak`` times or more in a row get a counter-example and a warning rule,
    keys that pass lose theirs. ``dims`` holds rubric dimensions (``ordinal``,
    ``eval_pos``, ``dim``, ``score``, ``reasoning``, ``suggestion``). ``best``,
    ``history``, ``negatives`` and ``rules`` of the result are the next round's.
    """
    made, failures = items_for_plan(plan, responses)
    items, known = _completed(made.withColumn("ordinal", F.col("plan_pos")), best, cached)
    items = durable(items)
    scores = durable(score_items(items, scorer, known))
    scored = items.join(scores.select("ordinal", "score", "status", "message"), "ordinal", "left")
    own = scored.select(F.lit(round_no).cast("long").alias("round"), "ordinal", *joins.KEY, "score")
    past = durable(own if history is None else history.select(*own.columns).unionByName(own))
    out = {
        "items": items, "failures": failures, "scores": scores, "breakdown": aggs.score_breakdown(scored),
        "summary": aggs.evaluation_summary(scored), "failed": joins.failed_keys(scored, joins.KEY), "stats": mend.plan_stats(items),
        "best": scored.select(*_ITEM, "score"), "history": past,
    }
    rates = past.groupBy("round").agg(F.count("score").alias("n"), F.count_if(F.col("score") >= V.PASS_SCORE).alias("k"))
    rates = rates.select(F.lit("run").alias("run"), "round", aggs.percent("k", "n").alias("pass_rate"))
    out["progress"] = ranks.progress_track(rates, patience, target, by=["run"]).drop("run")

    # rounds follow each other, so the newest rows of a key are those of the newest round
    placed = past.withColumn("place", F.col("round") * (1 << 40) + F.col("ordinal"))
    streaks = ranks.failing_streaks(placed, min_streak, ordinal="place")
    stored = stored_rules if stored_rules is not None else plan.sparkSession.createDataFrame([], _RULES)
    fresh, warned = rules.inject_negatives(streaks, items, stored)
    if negatives is not None:
        older = rules.clear_resolved(negatives, own).join(fresh.select(*joins.KEY), list(joins.KEY), "left_anti")
        fresh = fresh.unionByName(older.select(*fresh.columns))
    out["negatives"] = durable(fresh)
    if themes or dim_themes:
        new = _new_rules(_feedback(scored, dims), themes, dims, dim_themes or {})
        out["rules"] = rules.merge_rules(warned, new)
    else:
        out["rules"] = warned
    return out
