"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.session import shared_folder

#: Fixed value: the white space between words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: compressed, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(many: DataFrame, few: DataFrame, keys: dict[str, str], weight: str, hot: int = 1000) -> DataFrame:
    """Join many rows to one row per key (nulls are a key), so that no key's rows meet in one task.

    The ``hot`` keys of most rows (``weight``) are broadcast, ``hot`` rows at
    most; the other keys are shuffled. Both inputs are read twice.
    """
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in keys.items()])
    known = free_names(many.join(few.limit(0)), "known")[0]
    first = few.orderBy(F.col(weight).desc(), *keys.values()).limit(hot).withColumn(known, F.lit(True))
    marked = many.join(F.broadcast(first), same, "left")
    others = marked.filter(F.col(known).isNull()).select(*many.columns).join(few, same)
    return marked.filter(F.col(known)).drop(known).unionByName(others)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, which the optimiser cannot undo."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """Documents with another text; ``n_chars`` follows where the table has it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
