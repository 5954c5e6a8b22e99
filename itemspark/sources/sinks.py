"""Training sets, payloads and prompt bundles as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions.text import strip


def sft_lines(sft: DataFrame) -> DataFrame:
    """One JSON text per training row: ``{text, metadata}``; absent fields are left out."""
    meta = F.struct("source", "question_id", "recipe_id", "quality_score", "has_think_chain")
    rest = [c for c in sft.columns if c not in ("text", "source", "question_id", "recipe_id", "quality_score", "has_think_chain")]
    return sft.select(*rest, F.to_json(F.struct("text", meta.alias("metadata"))).alias("value"))


def dpo_lines(dpo: DataFrame) -> DataFrame:
    meta = F.struct("chosen_score", "rejected_score", "difficulty")
    rest = [c for c in dpo.columns if c not in ("prompt", "chosen", "rejected", "chosen_score", "rejected_score", "difficulty")]
    return dpo.select(*rest, F.to_json(F.struct("prompt", "chosen", "rejected", meta.alias("metadata"))).alias("value"))


def write_sft(sft: DataFrame, path: str) -> None:
    """JSON lines at ``path``/jsonl, and the flat rows as Parquet by source at ``path``/parquet."""
    sft_lines(sft).select("value").write.mode("overwrite").text(f"{path}/jsonl")
    sft.write.mode("overwrite").partitionBy("source").parquet(f"{path}/parquet")


def write_dpo(dpo: DataFrame, path: str) -> None:
    dpo_lines(dpo).select("value").write.mode("overwrite").text(f"{path}/jsonl")
    dpo.write.mode("overwrite").parquet(f"{path}/parquet")


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def export_payload(items: DataFrame, lesson_title: str | None = None) -> DataFrame:
    """Nested request per item for an external rubric service, as JSON in ``payload``."""
    have = set(items.columns)

    def given(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default)) if name in have else F.lit(default)

    kind = F.lower(strip(_text("type", "mcq")))
    subject, standard = given("subject", "ELA"), given("standard", "CCSS.ELA-LITERACY.L.3.1.E")
    letter = F.substring(F.upper(strip(_text("answer", "A"))), 1, 1)
    right = F.coalesce(F.try_element_at("answer_options", letter), F.try_element_at("answer_options", F.lower(letter)), F.lit(""))
    question = _text("question")
    worded = F.replace(F.replace(question, F.lit("Which word"), F.lit("Which choice")), F.lit("which word"), F.lit("which choice"))
    phrase = F.contains(strip(right), F.lit(" ")) & F.contains(F.lower(question), F.lit("which word")) & (kind != "msq")
    options = F.transform(F.map_entries("answer_options"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))
    empty = F.array().cast("array<struct<key:string,text:string>>")
    fill = kind == "fill-in"
    content = F.struct(
        F.when(~fill & phrase, worded).otherwise(question).alias("question"),
        F.when(fill, _text("answer")).when(kind == "msq", F.upper(strip(_text("answer", "A,B")))).otherwise(letter).alias("answer"),
        F.when(~fill, F.coalesce(options, empty)).alias("answer_options"),
        F.when(fill & (F.size("acceptable_answers") > 0), F.col("acceptable_answers")).alias("acceptable_answers"),
        _text("answer_explanation").alias("answer_explanation"),
    )
    lesson = F.lit(lesson_title) if lesson_title else F.concat(F.lit("K-12 "), subject)
    request = F.struct(
        given("grade", "3").alias("grade"), subject.alias("subject"), kind.alias("type"), _text("difficulty", "medium").alias("difficulty"),
        F.lit("en-US").alias("locale"),
        F.struct(lesson.alias("lesson_title"), standard.alias("substandard_id"), standard.alias("substandard_description")).alias("skills"),
    )
    ident = F.coalesce("id", F.col("ordinal").cast("string"))
    images = F.coalesce("image_url", F.array().cast("array<string>")) if "image_url" in have else F.array().cast("array<string>")
    payload = F.struct(
        ident.alias("id"), request.alias("request"), content.alias("content"), images.alias("image_url"),
        F.struct(ident.alias("generated_question_id")).alias("metadata"), F.lit(False).alias("verbose"),
    )
    return items.select("ordinal", F.to_json(payload).alias("payload"))


def export_prompt_bundle(prompts: DataFrame, version: str = "1.0") -> DataFrame:
    """One JSON line per key with its system and user text."""
    key = F.concat_ws("|", "standard", "difficulty", "type")
    entry = F.struct(
        F.lit(version).alias("version"), key.alias("key"), "standard", "difficulty", "type", F.col("system_prompt").alias("system"),
        F.col("user_prompt").alias("user"),
    )
    return prompts.select("standard", "difficulty", "type", F.to_json(entry).alias("value"))


