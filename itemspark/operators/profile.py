"""Corpus profiles of chat samples and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions import chat
from itemspark.functions import fixed_values as V
from itemspark.functions.text import est_tokens, strip
from itemspark.operators.aggs import percent
from itemspark.operators.parse import extract_json
from itemspark.skew import settle


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def _staged(samples: DataFrame) -> DataFrame:
    """The first thing wrong with a sample, or ``content`` when it can be looked into."""
    last = F.try_element_at("messages", F.lit(-1))
    content = F.coalesce(last["content"], F.lit(""))
    bad = F.coalesce(F.col("_parse_error"), F.lit(False)) if "_parse_error" in samples.columns else F.lit(False)
    stage = (
        F.when(bad | F.col("messages").isNull(), "parse_error").when(F.size("messages") == 0, "no_messages")
        .when(~last["role"].eqNullSafe("assistant"), "no_assistant").when(strip(content) == "", "empty_assistant").otherwise("content")
    )
    return samples.withColumn("stage", stage).withColumn("_content", F.when(stage == "content", content))


def _total_tokens() -> Column:
    sizes = F.transform("messages", lambda m: est_tokens(F.coalesce(m["content"], F.lit(""))))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, n: acc + n)


def _examined(samples: DataFrame) -> DataFrame:
    work = extract_json(settle(_staged(samples)), "_content")
    has = lambda n: F.try_variant_get("parsed", f"$.{n}", "variant").isNotNull()
    missing = F.filter(F.array(*[F.when(~has(f), f) for f in V.CHOICE_FIELDS]), lambda f: f.isNotNull())
    options = F.try_variant_get("parsed", "$.answer_options", "map<string,string>")
    keys = F.array_sort(F.array_distinct(F.transform(F.map_keys(options), lambda k: F.upper(k))))
    answer = F.upper(strip(F.coalesce(F.try_variant_get("parsed", "$.answer", "string"), F.lit(""))))
    inside = F.col("parsed").isNotNull()
    return work.withColumns(
        {
            "_n_tokens": F.when(F.col("stage") == "content", _total_tokens()),
            "_inside": inside,
            "_missing": F.when(inside, missing),
            "_bad_options": inside & options.isNotNull() & (keys != F.array(*map(F.lit, V.OPTION_LETTERS))),
            "_bad_answer": inside & (answer != "") & ~answer.isin(V.OPTION_LETTERS),
        }
    ).drop("parsed", "repair_path")


def profile_messages(samples: DataFrame) -> DataFrame:
    """Counters over chat samples, in fall-through order, with ratios over the valid ones."""
    d = _examined(samples)
    content = F.col("stage") == "content"
    got = d.agg(
        F.count(F.lit(1)).alias("total"), *[_count(F.col("stage") == s, s) for s in ("parse_error", "no_messages", "no_assistant", "empty_assistant")],
        _count(content & chat.has_think(F.col("_content"), closed=True), "has_think"),
        _count(F.col("_n_tokens") > V.SFT_MAX_TOKENS, "over_sft_max"), _count(content & ~F.col("_inside"), "no_json"),
        _count(F.size("_missing") > 0, "incomplete"), _count(F.col("_bad_options"), "bad_options"), _count(F.col("_bad_answer"), "bad_answer"),
    )
    valid = F.col("total") - F.col("parse_error")
    return got.withColumn("valid", valid).withColumns(
        {f"{c}_pct": percent(F.col(c), F.col("valid"), 2) for c in ("over_sft_max", "no_json", "incomplete")}
    )


def missing_fields(samples: DataFrame) -> DataFrame:
    return _examined(samples).select(F.explode("_missing").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def message_lengths(samples: DataFrame) -> DataFrame:
    """(role, n_tokens) of every message of a usable sample, and its total."""
    usable = _staged(samples).filter("stage = 'content'")
    parts = F.transform(
        F.filter("messages", lambda m: m["role"].isin(V.CHAT_ROLES)),
        lambda m: F.struct(m["role"].alias("role"), est_tokens(F.coalesce(m["content"], F.lit(""))).alias("n_tokens")),
    )
    total = F.array(F.struct(F.lit("total").alias("role"), _total_tokens().alias("n_tokens")))
    return usable.select(F.explode(F.concat(parts, total)).alias("e")).select("e.*")


def profile_pairs(pairs: DataFrame) -> DataFrame:
    """Counters over preference pairs: lengths, empty sides, and the order and gap of the scores."""
    whole = pairs.filter("prompt is not null and chosen is not null and rejected is not null")
    joined = F.array_join(F.transform("prompt", lambda m: F.coalesce(m["content"], F.lit(""))), "")
    side = lambda c: F.coalesce(F.col(f"{c}.content"), F.lit(""))
    gap = F.col("metadata.chosen_score") - F.col("metadata.rejected_score")
    got = whole.agg(
        F.count(F.lit(1)).alias("valid"), _count(F.size("prompt") == 0, "no_prompt"),
        _count(est_tokens(joined) > V.PROMPT_MAX_TOKENS, "over_prompt_max"),
        _count((est_tokens(side("chosen")) > V.RESPONSE_MAX_TOKENS) | (est_tokens(side("rejected")) > V.RESPONSE_MAX_TOKENS), "over_response_max"),
        _count(strip(side("chosen")) == "", "empty_chosen"), _count(strip(side("rejected")) == "", "empty_rejected"),
        _count(gap <= 0, "score_order_wrong"), _count((gap > 0) & (gap < 0.05), "score_gap_small"),
    )
    return got.withColumn("over_prompt_pct", percent("over_prompt_max", "valid", 2)).withColumn(
        "over_response_pct", percent("over_response_max", "valid", 2)
    )


def pair_lengths(pairs: DataFrame) -> DataFrame:
    whole = pairs.filter("prompt is not null and chosen is not null and rejected is not null")
    joined = F.array_join(F.transform("prompt", lambda m: F.coalesce(m["content"], F.lit(""))), "")
    sides = {"prompt": joined, "chosen": F.col("chosen.content"), "rejected": F.col("rejected.content")}
    parts = [F.struct(F.lit(n).alias("role"), est_tokens(F.coalesce(c, F.lit(""))).alias("n_tokens")) for n, c in sides.items()]
    return whole.select(F.explode(F.array(*parts)).alias("e")).select("e.*")
