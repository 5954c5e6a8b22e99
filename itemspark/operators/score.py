"""Scoring with a caller's function, and rules given as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V
from itemspark.session import ship

ship(__name__)

Scorer = Callable[[dict], float]


def _score_one(scorer: Scorer, item: dict, zero_tries: int, error_tries: int) -> tuple[float | None, str, str | None, int]:
    """Score, status, message and number of calls. A zero must repeat before it is believed."""
    zeros, errors, calls = 0, 0, 0
    while True:
        calls += 1
        try:
            value = scorer(item)
        except Exception as e:  # noqa: BLE001 - whatever the caller's scorer raises becomes an error row
            errors += 1
            if errors >= error_tries:
                return None, "error", f"{type(e).__name__}: {e}", calls
            continue
        if value is None:
            return None, "error", "no score", calls
        if value > 0:
            return float(value), "ok", None, calls
        zeros += 1
        if zeros >= zero_tries:
            return 0.0, "ok", None, calls


def score_items(
    items: DataFrame, scorer: Scorer, cached: DataFrame | None = None, key: str = "ordinal", partitions: int | None = None,
    zero_tries: int = 3, error_tries: int = 5,
) -> DataFrame:
    """Score every item once; items with a cached score are not sent to the scorer.

    ``partitions`` sets how many scorers work at the same time. Item columns
    reach the scorer as a plain dictionary.
    """
    kind = items.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, score double, status string, message string, calls bigint"

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (item[key], *_score_one(scorer, item, zero_tries, error_tries)) for item in part.to_dict("records")
            ]
            yield pd.DataFrame(rows, columns=[key, "score", "status", "message", "calls"])

    todo = items
    if cached is not None:
        todo = items.join(cached.filter("score is not null").select(key), key, "left_anti")
    if partitions:
        todo = todo.repartition(partitions)
    fresh = todo.mapInPandas(batches, schema)
    if cached is None:
        return fresh
    none = F.lit(None).cast("string")
    kept = cached.filter("score is not null").join(items.select(key), key, "left_semi").select(
        key, "score", F.lit("cached").alias("status"), none.alias("message"), F.lit(0).cast("long").alias("calls")
    )
    return fresh.unionByName(kept)


def completeness_scorer(fields: Sequence[str] = ("question", "answer", "answer_explanation")) -> Scorer:
    """A local stand-in for a rubric service: the share of the given fields that are filled."""
    names = list(fields)

    def scorer(item: dict) -> float:
        return sum(bool(str(item.get(f) or "").strip()) for f in names) / len(names)

    return scorer


def score_in_waves(candidates: DataFrame, scorer: Scorer, keys: Sequence[str], waves: int, passing: float = V.PASS_SCORE) -> DataFrame:
    """Score the first candidate of every key, then the second of the keys still without a pass, and so on.

    ``candidates`` has a 1-based ``rank`` in its key. Each wave is written out so
    that the scorer is not called twice for it.
    """
    from itemspark.session import durable

    done = None
    for rank in range(1, waves + 1):
        turn = candidates.filter(F.col("rank") == rank)
        if done is not None:
            met = done.filter(F.col("score") >= passing).select(*keys).distinct()
            turn = turn.join(met, list(keys), "left_anti")
        scored = score_items(turn, scorer).select("ordinal", "score", "status")
        wave = durable(turn.select(*keys, "ordinal", "rank").join(scored, "ordinal"))
        done = wave if done is None else done.unionByName(wave)
    return done
