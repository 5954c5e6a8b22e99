"""Small tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

WORDS = "amber basin cedar delta ember fjord grove heron inlet jetty knoll ledge maple north ocean prairie quartz river slope tundra".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars int, size long, key string, piece int, target string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def texts() -> list[str | None]:
    shared = prose(900, 80)
    line = "This very line stands in a great many of the documents"
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out: list[str | None] = [None, "", " \t\n ", "one", "one", "two words", "Two WORDS", base, base, base.upper(), " ".join(near)]
    out += [prose(k, 20) + "\n" + line + "\n" + prose(k + 50, 30) + ("\n" + shared if k % 2 else "") for k in range(10, 18)]
    out += [line, line.upper() + "  ", "\n" + line + "\n\n", "ü€😀 " * 300, "ab" * 400, prose(77, 9000), "\x00 odd   \x85 characters", prose(5, 4), prose(5, 3)]
    return out


def rows() -> list[tuple]:
    names = ["web", "web", "web", "books", "books", None, "", "Ünï", "zz"]
    made = [(k * 3 + 1, t, "en", names[k % len(names)], len(t or ""), 7, "k", 0, "x") for k, t in enumerate(texts())]
    return made + [(k + 1000, f"{prose(300, 60)} tail{k}.", "en", "web", 1, 7, "k", 0, "x") for k in range(12)]


@pytest.fixture(scope="session")
def schema() -> str:
    return DOCS


@pytest.fixture(scope="session")
def fixture_rows() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory) -> str:
    """A folder of tables as the queries read them."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="session")
def no_rows(spark, tmp_path_factory) -> str:
    """The given tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "embeddings", "pages", "conversations"):
        given = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        spark.createDataFrame([], T.StructType(given.schema.fields)).write.parquet(f"{folder}/{name}.parquet")
    return folder
