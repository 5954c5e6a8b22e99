"""The queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.llm import chat_format, divergence, html_text, language_id, line_dedup, mixing, near_duplicates, packing, quality, suffix_dedup, top_k, vector_codes, warc
from itemspark.llm.common import read
from itemspark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_rules(read(spark, folder, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"quality.{n}") for n in names])


@query
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = top_k.whole_vectors(read(spark, folder, "embeddings"))
    return top_k.exact_top_k(vectors, F.col("id") % 50 == 0, 5)


@query
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat_format.chat_digest(chat_format.format_chats(rows.unionByName(extra)))


@query
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read(spark, folder, "pages"), path)
    back = warc.read_archives(spark, path)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digest(read(spark, folder, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, folder, "documents"), width=4, percent=85)


@query
def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = html_text.extract_text(read(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(read(spark, folder, "documents"), window=200)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(read(spark, folder, "documents"))


@query
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(read(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(read(spark, folder, "documents")).drop("rejected")
