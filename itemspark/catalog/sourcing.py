"""A: sources and sinks."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.catalog.validation import item_rows
from itemspark.operators import aggs, training
from itemspark.sources import documents, json_text, sinks


def chats(d):
    """Conversations as samples with a ``messages`` array."""
    turns = d.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"),
        F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"), F.lit("r1").alias("recipe_id"),
    )


def pairs(d):
    """Preference samples with a prompt array."""
    p = d.view("pairs")
    content = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("content")))
    return p.select(
        "conv_id", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"),
        content("chosen").alias("chosen"), content("rejected").alias("rejected"),
        F.struct("chosen_score", "rejected_score", F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("string").alias("standard")).alias("metadata"),
    )


@query("a1_read_jsonl", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_type = 'error' AS parse_error
FROM events WHERE event_type <> 'view'""")
def _(d):
    # views write blank lines, errors write broken ones
    line = F.when(F.col("event_type") == "view", " ").when(F.col("event_type") == "error", F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    got = json_text.json_lines(d.table("events").select("event_id", line.alias("line")), "line", "k bigint")
    return got.select("event_id", "k", F.col("_parse_error").alias("parse_error"))


@query("a2_read_json_docs", """
SELECT doc_id, 0 AS doc_pos, lang, n_chars FROM documents UNION ALL SELECT doc_id, 1, source, n_chars + 1 FROM documents WHERE doc_id % 2 = 1""")
def _(d):
    one = F.struct("lang", "n_chars")
    two = F.array(one, F.struct(F.col("source").alias("lang"), (F.col("n_chars") + 1).alias("n_chars")))
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(one)).otherwise(F.to_json(two))
    return json_text.json_docs(d.table("documents").select("doc_id", text.alias("value")), "value", "lang:string,n_chars:bigint")


@query("a3_classify_format", """
SELECT 'messages' AS format, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'dpo', count(*) FROM [pairs] UNION ALL SELECT 'unknown', count(*) FROM documents""")
def _(d):
    rows = chats(d).select("conv_id", "messages").unionByName(pairs(d).select("conv_id", "prompt", "chosen"), allowMissingColumns=True)
    rows = rows.unionByName(d.table("documents").select(F.col("doc_id").alias("conv_id")), allowMissingColumns=True)
    return json_text.classify_format(rows).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("a4_cap_per_file", """
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30""")
def _(d):
    return json_text.cap_per_file(d.table("documents").select("source", "doc_id"), 30, "source", "doc_id")


@query("a5_sample_per_file", """
SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CAST(concat('0x', substr(md5(concat('42|', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT)) <= 20""")
def _(d):
    return json_text.sample_per_file(d.table("documents").select("source", "doc_id"), 20, 42, "source", ["doc_id"])


@query("a6_sft_json_lines", """
SELECT conv_id, 'instruction_following' AS source, concat('q', CAST(conv_id AS VARCHAR)) AS question_id,
  CAST(sum(length(role) + length(text) + 24) AS BIGINT) AS n_chars
FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND arg_max(role, turn) = 'assistant'""")
def _(d):
    lines = sinks.sft_lines(training.sft_from_chats(chats(d), keep=["conv_id"]))
    get = lambda p: F.get_json_object("value", p)
    return lines.select("conv_id", get("$.metadata.source").alias("source"), get("$.metadata.question_id").alias("question_id"),
                        F.length(get("$.text")).cast("long").alias("n_chars"))


@query("a6_dpo_json_lines", """
SELECT conv_id, chosen, rejected, coalesce(chosen_score, 0.9) AS chosen_score FROM [pairs] WHERE rejected IS NOT NULL""")
def _(d):
    lines = sinks.dpo_lines(training.build_dpo(pairs(d), keep=["conv_id"]))
    get = lambda p: F.get_json_object("value", p)
    return lines.select("conv_id", get("$.chosen").alias("chosen"), get("$.rejected").alias("rejected"), get("$.metadata.chosen_score").cast("double").alias("chosen_score"))


_COURSE = "concat(CAST(1 + p_partkey % 12 AS VARCHAR), 'th Grade ', p_type)"


@query("a7_read_curriculum", f"""
SELECT p_partkey AS pos, concat('S.', CAST(p_partkey AS VARCHAR)) AS standard_id, 'ELA' AS subject_abbr, {_COURSE} AS course,
  CAST(1 + p_partkey % 12 AS VARCHAR) AS grade, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS standard_description,
  concat(p_brand, '|', p_type) AS learning_objectives, '' AS assessment_boundaries, p_name AS common_misconceptions FROM part""")
def _(d):
    course = F.concat((1 + F.col("p_partkey") % 12).cast("string"), F.lit("th Grade "), "p_type")
    text = F.concat(
        F.lit("## header line\n## another\nSubject: English Language Arts\nCourse: "), course, F.lit("\nUnit Name: U\nStandard ID: S."),
        F.col("p_partkey").cast("string"), F.lit("\nStandard Description: "),
        F.when(F.col("p_partkey") % 7 == 0, "*None specified*").otherwise(F.col("p_name")),
        F.lit("\nLearning Objectives:\n* "), "p_brand", F.lit("\n* "), "p_type",
        F.lit("\nAssessment Boundaries:\n* *None specified*\nCommon Misconceptions:\n* "), "p_name", F.lit("\nDifficulty Definitions:\n* easy"),
    )
    blocks = d.table("part").select(F.col("p_partkey").alias("pos"), text.alias("value"))
    got = documents.curriculum_standards(blocks, "value", {"English Language Arts": "ELA"})
    lists = [F.array_join(c, "|").alias(c) for c in ("learning_objectives", "assessment_boundaries", "common_misconceptions")]
    return got.select("pos", "standard_id", "subject_abbr", "course", "grade", "standard_description", *lists)


@query("a9_with_file_keys", """
SELECT ordinal, CASE model WHEN 'm0' THEN 'or/m0' WHEN 'm1' THEN 'fw/m1' ELSE model END AS model, grade,
  CASE WHEN ordinal % 2 = 1 THEN CAST(round AS DOUBLE) + 0.5 END AS best_rate FROM [eval_rows] WHERE ordinal % 3 <> 0""")
def _(d):
    slug = F.when(F.col("model") == "m0", "or_m0").when(F.col("model") == "m1", "fw_m1_matrix").otherwise(F.col("model"))
    rate = F.concat(F.col("round").cast("string"), F.lit("_5"))
    name = (
        F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("notes_"), slug))
        .when(F.col("ordinal") % 2 == 1, F.concat(F.lit("results_"), "grade", F.lit("_ELA_"), slug, F.lit("_best_"), rate, F.lit(".json")))
        .otherwise(F.concat(F.lit("results_"), slug, F.lit("_"), "grade", F.lit("_ELA.json")))
    )
    got = documents.with_file_keys(d.view("eval_rows").select("ordinal", name.alias("file"), "round"))
    return got.select("ordinal", "model", "grade", "best_rate")


def eval_files(d):
    """Evaluation files of 50 rows each, with parallel lists and two result layouts."""
    rows = d.view("eval_rows")
    overall = F.struct(F.col("score").alias("score"), F.concat(F.lit("why "), F.col("ordinal").cast("string")).alias("reasoning"))
    clarity = F.struct((F.col("score") - 0.25).alias("score"), F.lit("unclear").alias("reasoning"))
    dims = F.struct(overall.alias("overall"), clarity.alias("clarity"))
    nested = F.to_json(F.struct(F.struct(F.struct(dims.alias("rubric")).alias("e1")).alias("evaluations")))
    flat = F.to_json(F.struct(F.struct(dims.alias("e1")).alias("evaluations")))
    result = F.when(F.col("ordinal") % 2 == 0, nested).otherwise(flat)
    detail = F.struct(F.col("ordinal").alias("index"), "standard", "difficulty", "type", "score", "status", "message")
    entry = F.struct("ordinal", F.coalesce(F.col("score").cast("string"), F.lit("null")).alias("s"), result.alias("r"), F.to_json(detail).alias("d"))
    grouped = rows.groupBy(F.floor(F.col("ordinal") / 50).alias("file_id")).agg(F.array_sort(F.collect_list(entry)).alias("x"))

    def listed(field):
        return F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e[field]), ","), F.lit("]"))

    doc = F.concat(F.lit('{"scores":'), listed("s"), F.lit(',"results":'), listed("r"), F.lit(',"evaluation_details":'), listed("d"), F.lit("}"))
    return grouped.select("file_id", doc.alias("value"))


@query("a10_read_eval_files", """
SELECT CAST(floor(ordinal / 50) AS BIGINT) AS file_id, ordinal % 50 AS position, standard, difficulty, type, status, message, score FROM [eval_rows]""")
def _(d):
    got = documents.eval_file_rows(eval_files(d))
    return got.select("file_id", F.col("position").cast("long").alias("position"), "standard", "difficulty", "type", "status", "message", "score")


@query("a10_result_dims", """
SELECT ordinal, 'overall' AS dim, score, concat('why ', CAST(ordinal AS VARCHAR)) AS reasoning FROM [eval_rows]
UNION ALL SELECT ordinal, 'clarity', score - 0.25, 'unclear' FROM [eval_rows]""")
def _(d):
    rows = documents.eval_file_rows(eval_files(d)).select((F.col("file_id") * 50 + F.col("position")).alias("ordinal"), "result")
    return documents.result_dims(rows).select("ordinal", "dim", "score", "reasoning")


@query("a10_nested_scores", """
SELECT ordinal, CASE WHEN score IS NOT NULL THEN CASE WHEN ordinal % 2 = 0 THEN score ELSE (score + score / 2) / 2 END END AS score FROM [eval_rows]""")
def _(d):
    # no listed score: even rows have one evaluation under the rubric's key, odd rows two right under their ids
    overall = lambda s: F.struct(F.struct(s.alias("score")).alias("overall"))
    nested = F.to_json(F.struct(F.struct(F.struct(overall(F.col("score")).alias("marks")).alias("e1")).alias("evaluations")))
    flat = F.to_json(F.struct(F.struct(overall(F.col("score")).alias("e1"), overall(F.col("score") / 2).alias("e2")).alias("evaluations")))
    result = F.when(F.col("ordinal") % 2 == 0, nested).otherwise(flat)
    doc = F.concat(F.lit('{"scores":[null],"results":['), result, F.lit("]}"))
    files = d.view("eval_rows").select("ordinal", doc.alias("value"))
    return documents.eval_file_rows(files, rubric_key="marks").select("ordinal", "score")


@query("a10_low_dimensions", """
SELECT ordinal, 'clarity' AS dim, score AS item_score, score - 0.25 AS score FROM [eval_rows] WHERE score < 0.85 AND score - 0.25 < 0.85""")
def _(d):
    rows = documents.eval_file_rows(eval_files(d)).withColumn("ordinal", F.col("file_id") * 50 + F.col("position"))
    return aggs.dimension_failures(documents.result_dims(rows)).select("ordinal", "dim", "item_score", "score")


@query("a10_broken_files", """
SELECT doc_id FROM documents WHERE doc_id % 3 <> 0""")
def _(d):
    text = F.when(F.col("doc_id") % 3 == 0, F.lit('{"scores":[0.5]}')).when(F.col("doc_id") % 3 == 1, F.lit('{"scores":[0.5')).otherwise(F.col("text"))
    return documents.broken_eval_files(d.table("documents").select("doc_id", text.alias("value"))).select("doc_id")


# the stored lists are the ones a merge leaves: distinct rules, the last 10 (global) or 3 of a key
@query("a11_rules_round_trip", """
WITH k AS (SELECT scope, CASE WHEN scope = 'global' THEN NULL ELSE standard END AS standard, CASE WHEN scope = 'standard_difficulty' THEN difficulty END AS difficulty,
  CASE WHEN scope = 'standard_difficulty' THEN type END AS type, pos, rule FROM [rules]),
g AS (SELECT scope, standard, difficulty, type, min(pos) AS pos, arg_max(rule, pos) AS rule FROM k GROUP BY scope, standard, difficulty, type, lower(rule)),
c AS (SELECT scope, standard, difficulty, type, row_number() OVER (PARTITION BY scope, standard, difficulty, type ORDER BY pos) - 1 AS pos, rule FROM g)
SELECT scope, standard, difficulty, type, pos, rule, CAST(NULL AS BIGINT) AS streak FROM c
UNION ALL SELECT 'negative', standard, difficulty, type, 0, concat('row ', bad_ordinal), streak FROM [negatives]""")
def _(d):
    from itemspark.catalog.prompting import merged_rules

    shown = F.concat(F.lit("row "), F.col("bad_ordinal").cast("string")).alias("bad_question")
    negatives = d.view("negatives").select("standard", "difficulty", "type", shown, F.lit("A").alias("bad_answer"), "streak")
    docs = documents.rule_docs(merged_rules(d), negatives).select("value")
    own = documents.read_negatives(docs)
    told = own.select(F.lit("negative").alias("scope"), "standard", "difficulty", "type", F.lit(0).cast("long").alias("pos"), F.col("bad_question").alias("rule"), "streak")
    return documents.read_rules(docs).withColumn("streak", F.lit(None).cast("long")).unionByName(told)


@query("a12_export_payload", """
SELECT ordinal, id, type, standard, difficulty, '3' AS grade, 'K-12 ELA' AS lesson, coalesce(question, '') AS question,
  CASE type WHEN 'fill-in' THEN answer WHEN 'msq' THEN upper(answer) ELSE upper(substr(answer, 1, 1)) END AS answer, opt_a AS first_option, acceptable_1 AS accepted FROM [items]""")
def _(d):
    got = sinks.export_payload(item_rows(d))
    get = lambda p: F.get_json_object("payload", p)
    return got.select(
        "ordinal", get("$.id").alias("id"), get("$.request.type").alias("type"), get("$.request.skills.substandard_id").alias("standard"),
        get("$.request.difficulty").alias("difficulty"), get("$.request.grade").alias("grade"), get("$.request.skills.lesson_title").alias("lesson"),
        get("$.content.question").alias("question"), get("$.content.answer").alias("answer"), get("$.content.answer_options[0].text").alias("first_option"),
        get("$.content.acceptable_answers[0]").alias("accepted"),
    )
