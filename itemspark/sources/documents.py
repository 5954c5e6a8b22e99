"""Curriculum texts, evaluation files, rule stores and scored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions.curriculum import grade_of_course
from itemspark.functions import fixed_values as V
from itemspark.functions.text import strip

# fixed values: the layout of a curriculum text
_BLOCK_END = "\n---\n"
_SECTIONS = {
    "learning_objectives": r"(?s)Learning Objectives:\n(.*?)(?=\n(?:Assessment Boundaries|Common Misconceptions|Difficulty Definitions|$))",
    "assessment_boundaries": r"(?s)Assessment Boundaries:\n(.*?)(?=\n(?:Common Misconceptions|Difficulty Definitions|$))",
    "common_misconceptions": r"(?s)Common Misconceptions:\n(.*?)(?=\n(?:Difficulty Definitions|$))",
}
_NOTHING = ["*None specified*", "None specified"]


def _value(block: Column, key: str) -> Column:
    found = F.regexp_extract_all(block, F.lit(rf"(?m)^{key}:[ \t]*(.*)$"), F.lit(1))
    return strip(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))


def _bullets(block: Column, pattern: str) -> Column:
    lines = F.transform(F.split(F.regexp_extract(block, pattern, 1), "\n"), strip)
    entries = F.transform(F.filter(lines, lambda s: s.startswith("* ")), lambda s: strip(F.substring(s, 3, 2147483647)))
    return F.filter(entries, lambda e: (e != "") & ~e.isin(_NOTHING))


def curriculum_standards(blocks: DataFrame, text: str = "value", subjects: dict[str, str] | None = None) -> DataFrame:
    """One row per block with a served grade: names, description and the three bullet lists."""
    block = F.regexp_replace(text, r"(?s)^(?:\s*#[^\n]*\n)+", "")
    rest = [c for c in blocks.columns if c != text]
    subject = _value(F.col("_b"), "Subject")
    short = subject
    for name, abbreviation in (subjects or {}).items():
        short = F.when(subject == name, abbreviation).otherwise(short)
    described = _value(F.col("_b"), "Standard Description")
    out = blocks.select(*rest, block.alias("_b")).select(
        *rest, _value(F.col("_b"), "Standard ID").alias("standard_id"), subject.alias("subject"), short.alias("subject_abbr"),
        _value(F.col("_b"), "Course").alias("course"), grade_of_course(_value(F.col("_b"), "Course")).alias("grade"),
        _value(F.col("_b"), "Unit Name").alias("unit_name"), _value(F.col("_b"), "Cluster Name").alias("cluster_name"),
        F.when(described.isin(_NOTHING), "").otherwise(described).alias("standard_description"),
        *[_bullets(F.col("_b"), p).alias(n) for n, p in _SECTIONS.items()],
    )
    return out.filter((F.col("standard_id") != "") & ~F.col("grade").isin(V.SKIPPED_GRADES))


def read_curriculum(spark: SparkSession, path: str, subjects: dict[str, str] | None = None) -> DataFrame:
    """Blocks of a curriculum text; ``pos`` keeps their order for choosing the first block of a standard."""
    lines = spark.read.option("lineSep", _BLOCK_END).text(path)
    return curriculum_standards(lines.withColumn("pos", F.monotonically_increasing_id()), "value", subjects)


# ---- evaluation files -------------------------------------------------------
def with_file_keys(df: DataFrame, file: str = "file", subject: str = "ELA") -> DataFrame:
    """Model, grade and best rate from the two result file names; other files are dropped."""
    plain = rf"^results_(.+?)_([^_]+)_{subject}\.json$"
    best = rf"^results_(\d+)_{subject}_(.+?)_best_([\d_]+)\.json$"
    is_plain, is_best = F.rlike(file, F.lit(plain)), F.rlike(file, F.lit(best))
    slug = F.when(is_plain, F.regexp_extract(file, plain, 1)).otherwise(F.regexp_extract(file, best, 2))
    slug = F.regexp_replace(slug, "_matrix$", "")
    model = F.when(slug.startswith("or_"), F.concat(F.lit("or/"), F.substring(slug, 4, 2147483647))).otherwise(
        F.replace(slug, F.lit("fw_"), F.lit("fw/"))
    )
    grade = F.when(is_plain, F.regexp_extract(file, plain, 2)).otherwise(F.regexp_extract(file, best, 1))
    rate = F.replace(F.nullif(F.regexp_extract(file, best, 3), F.lit("")), F.lit("_"), F.lit(".")).try_cast("double")
    return df.filter(is_plain | is_best).withColumns({"model": model, "grade": grade, "best_rate": F.when(~is_plain, rate)})


_EVAL_FILE = (
    "scores array<double>, results array<variant>, evaluation_details array<struct<index:bigint,standard:string,"
    "difficulty:string,type:string,score:double,elapsed_s:double,status:string,message:string>>"
)


def eval_file_rows(files: DataFrame, text: str = "value", rubric_key: str = "rubric") -> DataFrame:
    """Rows of evaluation files: the parallel lists zipped by position, with the raw result.

    A row without a listed score takes the one of its details, of the result, or
    the mean of the result's evaluations. Files that give no row are found by
    ``broken_eval_files``.
    """
    rest = [c for c in files.columns if c != text]
    doc = files.select(*rest, F.from_json(text, _EVAL_FILE).alias("j"))
    n = _list_length("j")
    at = doc.select(*rest, "j", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("position"))
    row = at.select(
        *rest, "position", F.get("j.scores", F.col("position")).alias("list_score"),
        F.get("j.results", F.col("position")).alias("result"), F.get("j.evaluation_details", F.col("position")).alias("d"),
    )
    detail = [F.col(f"d.{c}").alias(c) for c in ("standard", "difficulty", "type", "status", "message", "elapsed_s")]
    stated = F.try_variant_get("result", "$.overall_score", "double")
    return row.select(*rest, "position", *detail, F.coalesce("list_score", "d.score", stated, nested_score(F.col("result"), rubric_key)).alias("score"), "result")


def _list_length(doc: str) -> Column:
    return F.greatest(*[F.coalesce(F.size(f"{doc}.{c}"), F.lit(0)) for c in ("scores", "results", "evaluation_details")])


def broken_eval_files(files: DataFrame, text: str = "value") -> DataFrame:
    """Files that give no row: no JSON, or none of the lists has an entry. All columns are kept."""
    read = files.withColumn("_j", F.from_json(text, _EVAL_FILE))
    return read.filter(F.col("_j").isNull() | (_list_length("_j") == 0)).drop("_j")


def nested_score(result: Column, rubric_key: str = "rubric") -> Column:
    """Mean overall score of a result's evaluations that have one, each under ``rubric_key`` or right under its id."""
    evaluations = F.map_values(F.try_variant_get(result, "$.evaluations", "map<string,variant>"))
    one = lambda e: F.coalesce(*[F.try_variant_get(e, p, "double") for p in (f"$.{rubric_key}.overall.score", "$.overall.score")])
    found = F.filter(F.transform(evaluations, one), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, s: a + s) / F.size(found))


def result_dims(rows: DataFrame, rubric_key: str = "rubric", result: str = "result") -> DataFrame:
    """One row per rubric dimension and evaluation of a result.

    An evaluation holds its dimensions under ``rubric_key``, or right under its id.
    A ``score`` of the row itself becomes ``item_score``.
    """
    rows = rows.withColumnRenamed("score", "item_score")
    rest = [c for c in rows.columns if c != result]
    evaluations = F.map_entries(F.try_variant_get(result, "$.evaluations", "map<string,variant>"))
    ev = rows.select(*rest, F.posexplode(evaluations).alias("eval_pos", "_e"))
    dims = F.coalesce(
        F.try_variant_get("_e.value", f"$.{rubric_key}", "map<string,variant>"), F.try_variant_get("_e.value", "$", "map<string,variant>")
    )
    one = ev.select(*rest, F.col("eval_pos").cast("long").alias("eval_pos"), F.explode(dims).alias("dim", "v"))
    get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    return one.select(
        *rest, "eval_pos", "dim", get("score", "double").alias("score"), get("reasoning").alias("reasoning"),
        get("internal_reasoning").alias("internal_reasoning"), get("suggested_improvements").alias("suggestion"),
    )


# ---- rule stores ------------------------------------------------------------
_RULE_DOC = (
    "global_rules array<string>, by_standard map<string,array<string>>, by_standard_difficulty map<string,array<string>>, "
    "negative_examples map<string,struct<bad_question:string,bad_answer:string,streak:bigint,instruction:string>>"
)
_NEGATIVE = ["bad_question", "bad_answer", "streak", "instruction"]


def read_rules(docs: DataFrame, text: str = "value") -> DataFrame:
    """Rule documents -> (scope, standard, difficulty, type, pos, rule)."""
    rest = [c for c in docs.columns if c != text]
    j = docs.select(*rest, F.from_json(text, _RULE_DOC).alias("j"))
    none = F.lit(None).cast("string")
    glob = j.select(*rest, F.lit("global").alias("scope"), none.alias("key"), F.posexplode("j.global_rules").alias("pos", "rule"))
    std = j.select(*rest, F.explode("j.by_standard").alias("key", "r")).select(
        *rest, F.lit("standard").alias("scope"), "key", F.posexplode("r").alias("pos", "rule")
    )
    full = j.select(*rest, F.explode("j.by_standard_difficulty").alias("key", "r")).select(
        *rest, F.lit("standard_difficulty").alias("scope"), "key", F.posexplode("r").alias("pos", "rule")
    )
    part = F.split("key", r"\|")
    out = glob.unionByName(std).unionByName(full)
    return out.select(
        *rest, "scope", F.get(part, F.lit(0)).alias("standard"), F.get(part, F.lit(1)).alias("difficulty"),
        F.get(part, F.lit(2)).alias("type"), F.col("pos").cast("long").alias("pos"), "rule",
    )


def read_negatives(docs: DataFrame, text: str = "value") -> DataFrame:
    """Counter-examples of rule documents: one row per key, a key of fewer than three parts has nulls."""
    rest = [c for c in docs.columns if c != text]
    found = docs.select(*rest, F.explode(F.from_json(text, _RULE_DOC)["negative_examples"]).alias("key", "n"))
    part = F.split("key", r"\|")
    return found.select(*rest, *[F.get(part, F.lit(i)).alias(c) for i, c in enumerate(("standard", "difficulty", "type"))], "n.*")


def rule_docs(rules: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Rules and counter-examples -> one JSON document per standard (and one for the global rules).

    ``negatives`` has the key columns, bad_question, bad_answer, streak and
    (optionally) instruction; a key's counter-example is stored beside its rules.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda x: x["rule"])
    keyed = rules.withColumn(
        "key", F.when(F.col("scope") == "standard_difficulty", F.concat_ws("|", "standard", "difficulty", "type")).when(F.col("scope") == "standard", F.col("standard"))
    )
    home = F.when(F.col("scope") != "global", F.col("standard"))
    lists = keyed.groupBy(home.alias("standard"), "scope", "key").agg(ordered.alias("r"))

    def entries(scope: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("scope") == scope, F.struct("key", "r"))))

    doc = lists.groupBy("standard").agg(
        F.first(F.when(F.col("scope") == "global", F.col("r")), ignorenulls=True).alias("global_rules"),
        entries("standard").alias("by_standard"), entries("standard_difficulty").alias("by_standard_difficulty"),
    )
    parts = ["global_rules", "by_standard", "by_standard_difficulty"]
    if negatives is not None:
        shown = [F.col(c) if c in negatives.columns else F.lit(None).cast("string").alias(c) for c in _NEGATIVE]
        entry = F.struct(F.concat_ws("|", "standard", "difficulty", "type").alias("key"), F.struct(*shown).alias("n"))
        own = negatives.groupBy(F.col("standard").alias("_standard")).agg(F.map_from_entries(F.collect_list(entry)).alias("negative_examples"))
        doc = doc.join(own, doc["standard"].eqNullSafe(own["_standard"]), "full")
        doc = doc.withColumn("standard", F.coalesce("standard", "_standard")).drop("_standard")
        parts.append("negative_examples")
    return doc.select("standard", F.to_json(F.struct(*parts)).alias("value"))


def write_rules(rules: DataFrame, path: str, negatives: DataFrame | None = None) -> None:
    rule_docs(rules, negatives).select("value").write.mode("overwrite").text(path)


# ---- question store ---------------------------------------------------------
def read_scored_items(
    spark: SparkSession, options: dict[str, str], tables: dict[str, str], partition: tuple[str, int, int, int] | None = None
) -> dict[str, DataFrame]:
    """The three tables of a question store over JDBC; address and credentials come from the caller.

    ``partition`` is (column, lower, upper, parts) for a parallel read of the large table.
    """
    out = {}
    for name, table in tables.items():
        reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
        if partition and name == "generated":
            column, low, high, parts = partition
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        out[name] = reader.load()
    return out
