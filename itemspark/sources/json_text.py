"""JSON lines and documents, from files or from a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark import skew
from itemspark.functions.text import seeded_order
from itemspark.sources.json_arrays import read_json_docs

__all__ = [
    "broken_docs", "cap_per_file", "classify_format", "json_docs", "json_lines", "read_json_docs", "read_jsonl", "sample_per_file",
]

_BAD = "_corrupt_record"

CHAT_SCHEMA = (
    "messages array<struct<role:string,content:string>>, question_id string, recipe_id string, "
    "prompt array<struct<role:string,content:string>>, chosen struct<content:string>, rejected struct<content:string>, "
    "metadata struct<chosen_score:double,rejected_score:double,difficulty:string,standard:string>"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, keep_bad: bool = True) -> DataFrame:
    """One JSON object per line; blank lines vanish.

    A line that is no JSON is kept with ``_parse_error`` set, its text being in
    ``_line``, or dropped when ``keep_bad`` is false. ``_file`` names the source file.
    """
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file"))
    df = json_lines(lines, "_line", schema)
    return df if keep_bad else df.filter(~F.col("_parse_error")).drop("_line", "_parse_error")


def json_lines(df: DataFrame, text: str, schema: str) -> DataFrame:
    """The same for a column of JSON lines: adds the fields and ``_parse_error``.

    Each line is parsed once, whatever is filtered or selected later.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = F.from_json(text, f"{schema}, {_BAD} string", options)
    lines = skew.settle(df.filter(F.trim(text) != "").withColumn("_j", parsed))
    bad = F.col(f"_j.{_BAD}").isNotNull()
    return lines.select(*df.columns, "_j.*", bad.alias("_parse_error")).drop(_BAD)


def json_docs(df: DataFrame, text: str, schema: str) -> DataFrame:
    """A column whose documents hold one object or an array of objects -> one row per object.

    Documents that give no row are found by ``broken_docs``.
    """
    rest = [c for c in df.columns if c != text]
    entries = F.from_json(text, f"array<struct<{schema}>>")
    return df.select(*rest, F.posexplode(entries).alias("doc_pos", "_e")).select(*rest, "doc_pos", "_e.*")


def broken_docs(df: DataFrame, text: str, schema: str) -> DataFrame:
    """The documents that are no JSON object or array of objects, with all columns; blank ones count."""
    return df.filter(F.from_json(text, f"array<struct<{schema}>>").isNull())


def classify_format(df: DataFrame, out: str = "format") -> DataFrame:
    """``messages``, ``dpo`` or ``unknown`` per row, in that order."""

    def has(c: str):
        return F.col(c).isNotNull() if c in df.columns else F.lit(False)

    kind = F.when(has("messages"), "messages").when(has("prompt") & has("chosen"), "dpo").otherwise("unknown")
    return df.withColumn(out, kind)


def cap_per_file(df: DataFrame, n: int = 50_000, file: str = "_file", ordinal: str = "ordinal") -> DataFrame:
    """The first ``n`` rows of every file, also when one file holds most rows."""
    return skew.top_rows(df, [file], [ordinal], n)


def sample_per_file(
    df: DataFrame, n: int, seed: int = 42, file: str = "_file", key: Sequence[str] = ("ordinal",)
) -> DataFrame:
    """Exactly ``n`` rows (or all) of every file, by a seeded order of the row key."""
    drawn = df.withColumn("_draw", seeded_order(seed, *[F.col(k) for k in key]))
    return skew.top_rows(drawn, [file], ["_draw", *key], n).drop("_draw")
