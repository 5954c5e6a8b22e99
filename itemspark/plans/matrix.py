"""Evaluation files -> model x grade matrix, winners and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.operators import aggs, ranks
from itemspark.sources import documents


def read_evaluations(spark: SparkSession, path: str, subject: str = "ELA", rubric_key: str = "rubric") -> DataFrame:
    """Scored rows of all result files of a subject, with file, model and grade."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_name"))
    return documents.eval_file_rows(documents.with_file_keys(files, "file", subject), rubric_key=rubric_key)


def summarize_matrix(rows: DataFrame) -> dict[str, DataFrame]:
    """``rows`` has file, model, grade, type, difficulty and score; the best file of a cell counts."""
    runs = aggs.evaluation_summary(rows, by=["model", "grade", "file"])
    best = ranks.best_run_per_model_grade(runs).select("model", "grade", "file")
    rates = aggs.breakdown_rates(rows.join(best, ["model", "grade", "file"], "left_semi"))
    overall = rates.filter("level = 'overall'")
    matrix = aggs.score_matrix(overall)
    return {
        "matrix": matrix, "by_type": aggs.score_matrix(rates.filter("level = 'by_type'"), within=["type"]),
        "by_type_difficulty": aggs.score_matrix(rates.filter("level = 'by_type_difficulty'"), within=["type", "difficulty"]),
        "winners": aggs.matrix_winners(overall), "ranking": aggs.model_ranking(matrix),
    }
