"""Raw chat logs and preference pairs -> training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.operators import profile, training
from itemspark.sources import json_text, sinks


def training_sets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supervised rows, preference rows) of raw samples of either shape. No shuffle is needed."""
    kinds = json_text.classify_format(raw)
    chats, pairs = kinds.filter("format = 'messages'"), kinds.filter("format = 'dpo'")
    return training.build_sft(chats, pairs), training.build_dpo(pairs)


def process_data(spark: SparkSession, source: str, target: str) -> None:
    """Read JSON lines at ``source``; write sft, dpo and rejected lines under ``target``."""
    raw = json_text.read_jsonl(spark, source, json_text.CHAT_SCHEMA)
    sft, dpo = training_sets(raw.filter(~F.col("_parse_error")))
    sinks.write_sft(sft, f"{target}/sft")
    sinks.write_dpo(dpo, f"{target}/dpo")
    raw.filter("_parse_error").select("_file", "_line").write.mode("overwrite").json(f"{target}/rejected")


def profile_corpus(spark: SparkSession, source: str) -> dict[str, DataFrame]:
    """Counters and length profiles of a raw corpus."""
    kinds = json_text.classify_format(json_text.read_jsonl(spark, source, json_text.CHAT_SCHEMA))
    chats = kinds.filter("format = 'messages' or _parse_error")
    pairs = kinds.filter("format = 'dpo'")
    from itemspark.operators.aggs import length_summary

    return {
        "messages": profile.profile_messages(chats), "missing_fields": profile.missing_fields(chats),
        "message_lengths": length_summary(profile.message_lengths(chats)), "pairs": profile.profile_pairs(pairs),
        "pair_lengths": length_summary(profile.pair_lengths(pairs)),
    }
