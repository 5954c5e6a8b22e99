"""Error classes, low-score causes, money and call costs as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V
from itemspark.functions.text import has_any


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first pattern found in ``text``."""
    col = None
    for pattern, label in rules:
        hit = F.rlike(text, F.lit(pattern))
        col = F.when(hit, label) if col is None else col.when(hit, label)
    return col.otherwise(F.lit(default))


def failure_class(text: Column) -> Column:
    return first_match(text, [(p, c) for p, c, _ in V.RETRY_CLASSES], "unknown")


def retryable(text: Column) -> Column:
    final = [c for _, c, again in V.RETRY_CLASSES if not again]
    return ~failure_class(text).isin(final)


def log_class(line: Column) -> Column:
    return first_match(line, V.LOG_CLASSES)


def blame(reason: Column) -> Column:
    """Was it the service, or the item (or its request)?"""
    return F.when(has_any(F.lower(reason), V.SERVICE_WORDS), "service").otherwise("question_or_request")


def is_server_error(*parts: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *parts))
    return (text == "") | has_any(text, V.SERVER_ERROR_WORDS)


def low_score_causes(reasoning: Column) -> Column:
    """All matching causes; the whole reasoning when none matches."""
    low = F.lower(reasoning)
    hits = F.filter(
        F.array(*[F.when(has_any(low, keys), cause) for cause, keys in V.LOW_SCORE_CAUSES]), lambda c: c.isNotNull()
    )
    return F.when(F.size(hits) > 0, hits).when(reasoning != "", F.array(reasoning)).otherwise(F.array().cast("array<string>"))


def score_remarks(status: Column, message: Column, reasoning: Column) -> Column:
    """Why a row scored low: what broke where scoring failed (else its message), otherwise the causes named in the reasoning."""
    told = F.coalesce(message, F.lit(""))
    broke = first_match(told, V.SCORING_ERRORS)
    return F.when(status == "error", F.array(F.coalesce(broke, told))).otherwise(low_score_causes(F.coalesce(reasoning, F.lit(""))))


def currency(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("$")), "USD").when(F.startswith(text, F.lit("¥")), "CNY")


def amount(text: Column) -> Column:
    """Number after the currency sign; null when there is no sign or no number."""
    return F.when(currency(text).isNotNull(), F.substring(text, 2, 2147483647).try_cast("decimal(18,6)"))


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(p, m, a, b, c) for p, m, a, b, c in V.PRICES]
    df = spark.createDataFrame(rows, "provider string, model_key string, p_hit string, p_miss string, p_out string")
    return df.select("provider", "model_key", *[F.col(c).cast("decimal(10,4)") for c in ("p_hit", "p_miss", "p_out")])


def model_key(provider: Column, model: Column) -> Column:
    low = F.lower(F.trim(model))
    return F.when(provider == "fireworks", F.replace(low, F.lit("fw/"), F.lit(""))).when(
        provider == "openrouter", F.replace(F.replace(low, F.lit("or/"), F.lit("")), F.lit("openrouter/"), F.lit(""))
    ).otherwise(low)


def fallback_price(provider: Column, model: Column, position: int) -> Column:
    """Price of a call whose (provider, model) is not in the price table."""
    col = F.when(F.lit(False), F.lit(None).cast("decimal(10,4)"))
    reasoner = F.contains(F.lower(model), F.lit("reasoner"))
    for name, prices in V.DEFAULT_PRICES.items():
        col = col.when(provider == name, F.lit(prices[position]).cast("decimal(10,4)"))
    for (name, flag), prices in V.DIRECT_PRICES.items():
        hit = (provider == name) & (reasoner if flag else ~reasoner)
        col = col.when(hit, F.lit(prices[position]).cast("decimal(10,4)"))
    return col.otherwise(F.lit(0).cast("decimal(10,4)"))


def provider_currency(provider: Column) -> Column:
    col = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, code in V.CURRENCIES.items():
        col = col.when(provider == name, code)
    return col.otherwise("USD")
