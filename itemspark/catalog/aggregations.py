"""F: aggregations."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.catalog.validation import _REJECT, item_rows
from itemspark.functions import classes, text
from itemspark.operators import aggs, validate

_BREAKDOWN = """
SELECT CASE WHEN grouping(difficulty) = 1 THEN 'by_type' WHEN grouping(type) = 1 THEN 'by_difficulty'
            ELSE 'by_type_difficulty' END AS level,
       type, difficulty, count(*) AS count,
       CAST(sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS pass_count,
       round(CAST(100 * sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1) AS pass_rate,
       round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS avg_score
FROM {src} WHERE score IS NOT NULL
GROUP BY GROUPING SETS ((type), (difficulty), (type, difficulty))
"""


@query("f1_score_breakdown", _BREAKDOWN.format(src="[eval_rows]"))
def _(d):
    return aggs.score_breakdown(d.view("eval_rows"))


@query("f1_score_breakdown_lineitem", _BREAKDOWN.format(src="[eval_big]"))
def _(d):
    return aggs.score_breakdown(d.view("eval_big"))


@query("f2_evaluation_summary", """
SELECT model, grade, count(*) AS n_submitted, count(score) AS n_valid, count(*) - count(score) AS n_error,
  CAST(sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS pass_count,
  round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(score), 2) AS avg_score,
  round(CAST(100 * sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS DOUBLE) / count(score), 2) AS pass_rate,
  round(CAST(100 * sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 2) AS pass_rate_if_errors_as_fail
FROM [eval_rows] GROUP BY model, grade""")
def _(d):
    return aggs.evaluation_summary(d.view("eval_rows"), by=["model", "grade"])


@query("f2_error_details", """
SELECT ordinal, standard, difficulty, type, coalesce(nullif(message, ''), 'unknown') AS reason,
  CASE WHEN regexp_matches(lower(message), 'could not save|save evaluation|db|database|500|503|timeout|server error|internal|overall')
       THEN 'service' ELSE 'question_or_request' END AS blame
FROM [eval_rows] WHERE score IS NULL""")
def _(d):
    cols = ["ordinal", "standard", "difficulty", "type", "reason", "blame"]
    return aggs.error_details(d.view("eval_rows")).select(*cols)


@query("f3_dimension_counts", """
WITH s AS (SELECT difficulty, standard, 'ELA' AS subject FROM [items] WHERE question IS NOT NULL)
SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(standard) = 0 THEN 'standard'
            WHEN grouping(subject) = 0 THEN 'subject' ELSE 'total' END AS dimension,
  coalesce(difficulty, standard, subject) AS value, count(*) AS n
FROM s GROUP BY GROUPING SETS ((difficulty), (standard), (subject), ())""")
def _(d):
    rows = d.view("items").filter("question is not null").select("difficulty", "standard", F.lit("ELA").alias("subject"))
    return aggs.dimension_counts(rows)


@query("f3_top_standards", """
SELECT standard, count(*) AS n FROM [eval_rows] GROUP BY standard ORDER BY n DESC, standard LIMIT 10""")
def _(d):
    return aggs.top_values(d.view("eval_rows"), "standard", 10)


@query("f4_curriculum_dimensions", """
SELECT DISTINCT standard_id AS standard, difficulty, 'ELA' AS subject
FROM [curriculum_blocks], (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty) t
WHERE grade = '10' AND subject_abbr = 'ELA'""")
def _(d):
    return aggs.curriculum_dimensions(d.view("curriculum_blocks"), "9", "ELA")


@query("f5_length_summary", """
WITH t AS (SELECT role, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS n_tokens FROM conversations),
r AS (SELECT role, n_tokens, row_number() OVER (PARTITION BY role ORDER BY n_tokens) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM t)
SELECT role, count(*) AS n_rows, min(n_tokens) AS min_len,
  max(CASE WHEN i = least(CAST(floor(n * 50 / 100) AS BIGINT), n - 1) THEN n_tokens END) AS p50,
  max(CASE WHEN i = least(CAST(floor(n * 95 / 100) AS BIGINT), n - 1) THEN n_tokens END) AS p95,
  max(n_tokens) AS max_len, round(CAST(sum(n_tokens) AS DOUBLE) / count(*), 4) AS mean_len
FROM r GROUP BY role""")
def _(d):
    rows = d.table("conversations").select("role", text.est_tokens(F.col("text")).alias("n_tokens"))
    return aggs.length_summary(rows)


@query("f8_failure_counts", """
WITH c AS (
  SELECT 'reason' AS dimension, reason AS value, count(*) AS n FROM [failure_log] GROUP BY reason
  UNION ALL SELECT 'model', model, count(*) FROM [failure_log] GROUP BY model
  UNION ALL SELECT 'difficulty', difficulty, count(*) FROM [failure_log] GROUP BY difficulty
  UNION ALL SELECT 'standard', standard, count(*) FROM [failure_log] GROUP BY standard)
SELECT dimension, value, n FROM c""")
def _(d):
    return aggs.failure_counts(d.view("failure_log"))


_LOG_CLASS_SQL = """CASE WHEN regexp_matches(line, '\\[解析失败\\].*\\(第[0-9]+次') THEN 'parse_fail'
  WHEN regexp_matches(line, '(?i)429|Too Many Requests|rate.?limit') THEN 'rate_limit'
  WHEN regexp_matches(line, '(?i)timed?\\s*out|timeout|deadline') THEN 'timeout'
  WHEN regexp_matches(line, '(?i)500|502|503|internal.?server') THEN 'server_error'
  WHEN regexp_matches(line, '(?i)content.?filter|content.?management|moderation') THEN 'content_filter'
  WHEN regexp_matches(line, '(?i)connection.?(?:reset|refused|error)') THEN 'conn_error'
  WHEN regexp_matches(line, '(?i)no healthy upstream') THEN 'upstream'
  WHEN regexp_matches(line, '(?i)missing.?fields?.*answer_explanation') THEN 'missing_explanation'
  WHEN regexp_matches(line, '(?i)answer_options keys must be') THEN 'bad_options' END"""


@query("f9_log_error_counts", f"""
WITH l AS (SELECT model AS file, CASE WHEN event_id % 4 = 0 THEN concat('[解析失败] ', reason, ' (第', CAST(event_id % 5 AS VARCHAR), '次)') ELSE reason END AS line FROM [failure_log]),
c AS (SELECT file, {_LOG_CLASS_SQL} AS error_class FROM l)
SELECT CASE WHEN grouping(file) = 1 THEN 'by_class' WHEN grouping(error_class) = 1 THEN 'by_file' ELSE 'by_file_class' END AS level,
  file, error_class, count(*) AS n
FROM c WHERE error_class IS NOT NULL GROUP BY GROUPING SETS ((file, error_class), (error_class), (file))""")
def _(d):
    return aggs.log_error_counts(_log_lines(d))


def _log_lines(d):
    """Every fourth reason is a line of a failed parse as logs write it."""
    failed = F.concat(F.lit("[解析失败] "), "reason", F.lit(" (第"), (F.col("event_id") % 5).cast("string"), F.lit("次)"))
    return d.view("failure_log").select(F.col("model").alias("file"), F.when(F.col("event_id") % 4 == 0, failed).otherwise(F.col("reason")).alias("line"))


@query("f10_log_class_fixes", f"""
WITH l AS (SELECT CASE WHEN event_id % 4 = 0 THEN concat('[解析失败] ', reason, ' (第', CAST(event_id % 5 AS VARCHAR), '次)') ELSE reason END AS line FROM [failure_log]),
c AS (SELECT {_LOG_CLASS_SQL} AS error_class FROM l)
SELECT error_class, count(*) AS n, CASE error_class WHEN 'missing_explanation' THEN 'explanation aliases are already mapped; nothing to change'
  WHEN 'bad_options' THEN 'option keys are already normalised; retry, the model gave fewer than four options' WHEN 'rate_limit' THEN 'lower the worker count or widen the call interval'
  WHEN 'timeout' THEN 'raise the time-out or use a faster model' WHEN 'content_filter' THEN 'the model refused; change the prompt or the model'
  WHEN 'parse_fail' THEN 'look at raw_preview for truncation or text around the JSON' END AS fix
FROM c WHERE error_class IN ('missing_explanation', 'bad_options', 'rate_limit', 'timeout', 'content_filter', 'parse_fail') GROUP BY error_class""")
def _(d):
    counts = aggs.log_error_counts(_log_lines(d)).filter("level = 'by_class'")
    return aggs.log_class_fixes(counts)


@query("f10_suggested_fixes", """
WITH c AS (SELECT reason, count(*) AS n FROM [failure_log] GROUP BY reason),
k AS (SELECT reason, n, replace(lower(reason), ' ', '_') AS key FROM c)
SELECT * FROM (SELECT reason, n,
  CASE WHEN contains(key, 'missing_explanation') THEN 'explanation aliases are already mapped; nothing to change'
       WHEN contains(key, 'bad_options') THEN 'option keys are already normalised; retry, the model gave fewer than four options'
       WHEN contains(key, 'rate_limit') THEN 'lower the worker count or widen the call interval'
       WHEN contains(key, 'timeout') THEN 'raise the time-out or use a faster model'
       WHEN contains(key, 'content_filter') THEN 'the model refused; change the prompt or the model'
       WHEN contains(key, 'parse_fail') THEN 'look at raw_preview for truncation or text around the JSON'
       WHEN n >= 3 THEN 'look at raw_preview for the root cause' END AS fix FROM k) WHERE fix IS NOT NULL""")
def _(d):
    return aggs.suggested_fixes(d.view("failure_log"))


_RATE = "round(CAST(100 * sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1)"


@query("f11_weak_combos", f"""
SELECT type, difficulty, {_RATE} AS pass_rate FROM [eval_rows] WHERE score IS NOT NULL
GROUP BY type, difficulty HAVING {_RATE} < 83""")
def _(d):
    return aggs.weak_combos(d.view("eval_rows"), below=83)


@query("f11_weak_combos_marginal", f"""
WITH t AS (SELECT type, {_RATE} AS r FROM [eval_big] WHERE score IS NOT NULL GROUP BY type),
q AS (SELECT difficulty, {_RATE} AS r FROM [eval_big] WHERE score IS NOT NULL GROUP BY difficulty)
SELECT type, difficulty, (t.r + q.r) / 2 AS pass_rate FROM t, q WHERE (t.r + q.r) / 2 < 99""")
def _(d):
    return aggs.weak_combos_from_marginals(aggs.score_breakdown(d.view("eval_big")), below=99)


_GRADE_CELLS = ", ".join(f"max(CASE WHEN grade = '{g}' THEN r END) AS g{g}" for g in range(1, 13))
_MODEL_RATES = f"""p AS (SELECT model, grade, {_RATE} AS r FROM [eval_rows] WHERE score IS NOT NULL GROUP BY model, grade)"""
_MATRIX = f"""m AS (SELECT model, {_GRADE_CELLS},
  round(CAST(sum(CAST(r AS DECIMAL(18,6))) AS DOUBLE) / count(r), 1) AS avg_rate FROM p GROUP BY model)"""


@query("f12_score_matrix", f"WITH {_MODEL_RATES}, {_MATRIX} SELECT * FROM m")
def _(d):
    return aggs.score_matrix(aggs.breakdown_rates(d.view("eval_rows")).filter("level = 'overall'"))


@query("f12_score_matrix_by_type_difficulty", f"""
WITH p AS (SELECT model, grade, type, difficulty, {_RATE} AS r FROM [eval_rows] WHERE score IS NOT NULL GROUP BY model, grade, type, difficulty)
SELECT model, type, difficulty, {_GRADE_CELLS},
  round(CAST(sum(CAST(r AS DECIMAL(18,6))) AS DOUBLE) / count(r), 1) AS avg_rate FROM p GROUP BY model, type, difficulty""")
def _(d):
    rates = aggs.breakdown_rates(d.view("eval_rows")).filter("level = 'by_type_difficulty'")
    return aggs.score_matrix(rates, within=["type", "difficulty"])


@query("f13_matrix_winners", f"""
WITH {_MODEL_RATES}, w AS (SELECT grade, model, r, row_number() OVER (PARTITION BY grade ORDER BY r DESC, model) AS rn FROM p)
SELECT grade, model, r AS best_rate FROM w WHERE rn = 1""")
def _(d):
    return aggs.matrix_winners(aggs.breakdown_rates(d.view("eval_rows")).filter("level = 'overall'"))


@query("f13_model_ranking", f"""
WITH {_MODEL_RATES}, {_MATRIX}
SELECT model, coalesce(avg_rate, 0) AS avg_rate, row_number() OVER (ORDER BY coalesce(avg_rate, 0) DESC, model) AS rank FROM m""")
def _(d):
    return aggs.model_ranking(aggs.score_matrix(aggs.breakdown_rates(d.view("eval_rows")).filter("level = 'overall'")))


@query("f14_curriculum_meta", """
WITH p AS (SELECT DISTINCT grade, subject_abbr FROM [curriculum_blocks])
SELECT 'grade' AS side, grade AS key, string_agg(subject_abbr, ',' ORDER BY subject_abbr) AS vals, count(*) AS n_values FROM p GROUP BY grade
UNION ALL
SELECT 'subject', subject_abbr, string_agg(grade, ',' ORDER BY CAST(grade AS INT)), count(*) FROM p GROUP BY subject_abbr""")
def _(d):
    return aggs.curriculum_meta(d.view("curriculum_blocks")).withColumn("vals", F.array_join("vals", ","))


@query("f15_usage_totals", """
SELECT model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cache_hit_tokens) AS BIGINT) AS cache_hit_tokens,
  CAST(sum(prompt_tokens - cache_hit_tokens) AS BIGINT) AS cache_miss_tokens,
  round(CAST(sum(prompt_tokens + completion_tokens) AS DOUBLE) / count(*), 1) AS tokens_per_item
FROM [token_usage] GROUP BY model""")
def _(d):
    calls = d.view("token_usage").withColumn("cache_miss_tokens", F.expr("prompt_tokens - cache_hit_tokens"))
    return aggs.usage_totals(calls.withColumn("cost", F.lit(0))).drop("cost", "n_items")


@query("f16_round_log_summary", """
WITH r AS (SELECT *, concat(CASE WHEN round % 2 = 0 THEN '$' ELSE '¥' END, CAST(n_valid AS STRING), '.25') AS cost,
             n_submitted * 97 AS elapsed_s FROM [rounds]),
b AS (SELECT *, row_number() OVER (PARTITION BY model, grade ORDER BY pass_rate DESC NULLS LAST, round) AS rn FROM r)
SELECT model, grade, count(*) AS n_rounds,
  round(CAST(sum(CAST(pass_rate AS DECIMAL(18,6))) AS DOUBLE) / count(pass_rate), 2) AS average_pass_rate,
  max(pass_rate) AS best_pass_rate, max(CASE WHEN rn = 1 THEN round END) AS best_round,
  CAST(coalesce(sum(CASE WHEN cost LIKE '$%' THEN CAST(substr(cost, 2) AS DECIMAL(18,6)) END), 0) AS DECIMAL(18,2)) AS cost_usd,
  CAST(coalesce(sum(CASE WHEN cost LIKE '¥%' THEN CAST(substr(cost, 2) AS DECIMAL(18,6)) END), 0) AS DECIMAL(18,2)) AS cost_cny,
  CAST(sum(elapsed_s) AS BIGINT) // 3600 AS elapsed_h, (CAST(sum(elapsed_s) AS BIGINT) % 3600) // 60 AS elapsed_m
FROM b GROUP BY model, grade""")
def _(d):
    sign = F.when(F.col("round") % 2 == 0, "$").otherwise("¥")
    cost = F.concat(sign, F.col("n_valid").cast("string"), F.lit(".25"))
    rounds = d.view("rounds").withColumn("cost", cost).withColumn("elapsed_s", F.col("n_submitted") * 97)
    rounds = rounds.withColumn("currency", classes.currency(F.col("cost"))).withColumn("amount", classes.amount(F.col("cost")))
    return aggs.round_log_summary(rounds)


@query("f17_weak_item_counts", """
SELECT CASE WHEN grouping(difficulty) = 1 THEN 'by_type' WHEN grouping(type) = 1 THEN 'by_difficulty' ELSE 'by_type_difficulty' END AS level,
  type, difficulty, count(*) AS n FROM [eval_rows] WHERE coalesce(score, 1.0) < 0.85
GROUP BY GROUPING SETS ((type), (difficulty), (type, difficulty))""")
def _(d):
    return aggs.weak_item_counts(d.view("eval_rows"))


@query("f20_multi_model_summary", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model, grade ORDER BY round DESC) AS rn FROM [rounds])
SELECT model, grade, max(round) AS round_reached, max(CASE WHEN rn = 1 THEN pass_rate END) AS final_pass_rate,
  max(pass_rate) AS best_pass_rate, max(pass_rate) >= 90 AS target_reached,
  max(CASE WHEN rn = 1 THEN pass_count END) AS pass_count, max(CASE WHEN rn = 1 THEN n_valid END) AS n_valid,
  max(CASE WHEN rn = 1 THEN n_submitted END) AS n_submitted FROM r GROUP BY model, grade""")
def _(d):
    return aggs.multi_model_summary(d.view("rounds"), target=90, by=["model", "grade"])


@query("f21_cycle_report", """
WITH r AS (SELECT model, grade, CAST(floor((round - 1) / 6) AS INT) + 1 AS cycle, (round - 1) % 6 + 1 AS inner_round, pass_rate FROM [rounds]),
f AS (SELECT model, grade, cycle, arg_min_null(pass_rate, inner_round) AS first_rate, max(inner_round) - 1 AS repairs FROM r GROUP BY model, grade, cycle)
SELECT model, grade, string_agg(concat(CAST(cycle AS VARCHAR), ':', coalesce(CAST(CAST(round(first_rate * 10) AS BIGINT) AS VARCHAR), '-')), ' ' ORDER BY cycle) AS rates,
  round(CAST(sum(CAST(first_rate AS DECIMAL(18,6))) AS DOUBLE) / count(first_rate), 1) AS mean_rate,
  round(arg_max_null(first_rate, cycle) - arg_min_null(first_rate, cycle), 1) AS trend,
  CAST(sum(repairs) AS BIGINT) AS repair_rounds, count(*) AS n_cycles FROM f GROUP BY model, grade""")
def _(d):
    cycles = d.view("rounds").select(
        "model", "grade", F.expr("cast(floor((round - 1) / 6) as int) + 1").alias("cycle"),
        F.expr("(round - 1) % 6 + 1").alias("inner_round"), "pass_rate",
    )
    rate = lambda x: F.coalesce(F.round(x["first_rate"] * 10).cast("long").cast("string"), F.lit("-"))
    shown = F.array_join(F.transform("first_rates", lambda x: F.concat(x["cycle"].cast("string"), F.lit(":"), rate(x))), " ")
    return aggs.cycle_report(cycles, by=["model", "grade"]).withColumn("rates", shown).drop("first_rates")


@query("f22_plan_coverage", """
WITH k AS (SELECT DISTINCT standard, difficulty, type FROM [items]),
i AS (SELECT standard, difficulty, type, count(*) AS n FROM [eval_rows] WHERE score >= 0.85 AND round > 15 GROUP BY ALL),
c AS (SELECT standard, difficulty, type, count(*) AS n FROM [eval_rows] WHERE score >= 0.85 AND round <= 15 GROUP BY ALL)
SELECT k.standard, k.difficulty, k.type, coalesce(i.n, 0) AS n_incoming, coalesce(c.n, 0) AS n_current,
  coalesce(i.n, 0) = 0 AND coalesce(c.n, 0) = 0 AS uncovered
FROM k LEFT JOIN i USING (standard, difficulty, type) LEFT JOIN c USING (standard, difficulty, type)""")
def _(d):
    good = d.view("eval_rows").filter("score >= 0.85")
    keys = ["standard", "difficulty", "type"]
    return aggs.plan_coverage(d.view("items"), good.filter("round > 15"), good.filter("round <= 15"), keys)


@query("f23_repeated_failures", """
WITH f AS (SELECT standard, difficulty, reason, count(*) AS n FROM [failure_log] GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY standard, difficulty ORDER BY n DESC, reason) AS rn FROM f)
SELECT standard, difficulty, CAST(sum(n) AS BIGINT) AS n_failures, max(CASE WHEN rn = 1 THEN reason END) AS top_reason,
  max(CASE WHEN rn = 1 THEN n END) AS top_count FROM r GROUP BY standard, difficulty HAVING sum(n) >= 3""")
def _(d):
    return aggs.repeated_failures(d.view("failure_log"))


@query("f18_dimension_failures", """
SELECT 'clarity' AS dim, grade, count(*) AS n FROM [eval_rows] WHERE score < 0.85 AND score - 0.25 < 0.85 GROUP BY grade
UNION ALL SELECT 'fit', grade, count(*) FROM [eval_rows] WHERE score < 0.85 AND score / 2 < 0.4 GROUP BY grade""")
def _(d):
    dims = F.explode(F.array(
        F.struct(F.lit("overall").alias("dim"), F.col("score").alias("s")), F.struct(F.lit("clarity").alias("dim"), (F.col("score") - 0.25).alias("s")),
        F.struct(F.lit("fit").alias("dim"), F.when(F.col("score") / 2 < 0.4, 0.1).otherwise(0.9).alias("s")),
    )).alias("e")
    rows = d.view("eval_rows").select("ordinal", "grade", F.col("score").alias("item_score"), dims)
    rows = rows.select("ordinal", "grade", "item_score", F.lit(0).alias("eval_pos"), "e.dim", F.when(F.col("item_score").isNotNull(), F.col("e.s")).alias("score"))
    return aggs.dimension_failures(rows).groupBy("dim", "grade").agg(F.count(F.lit(1)).alias("n"))


@query("f19_item_score", """
SELECT standard, difficulty, round(CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(score), 6) AS mean_score,
  arg_min(score, ordinal) FILTER (WHERE score IS NOT NULL) AS first_score FROM [eval_rows] WHERE score IS NOT NULL GROUP BY ALL""")
def _(d):
    keys = ["standard", "difficulty"]
    ev = d.view("eval_rows").select(*keys, F.col("ordinal").alias("eval_pos"), F.lit("overall").alias("dim"), "score")
    both = aggs.item_score(ev, keys, "mean").withColumnRenamed("score", "mean_score")
    return both.join(aggs.item_score(ev, keys, "first").withColumnRenamed("score", "first_score"), keys)


@query("f5_approx_length_summary")
def _(d):
    return aggs.approx_length_summary(d.table("conversations").select("role", text.est_tokens(F.col("text")).alias("n_tokens")))


@query("f3_valid_item_dimensions", f"""
WITH s AS (SELECT difficulty, standard, 'ELA' AS subject FROM [items] WHERE ({_REJECT}) IS NULL)
SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(standard) = 0 THEN 'standard' WHEN grouping(subject) = 0 THEN 'subject' ELSE 'total' END AS dimension,
  coalesce(difficulty, standard, subject) AS value, count(*) AS n FROM s GROUP BY GROUPING SETS ((difficulty), (standard), (subject), ())""")
def _(d):
    good = validate.validate_schema(item_rows(d)).filter("reject_reason is null")
    return aggs.dimension_counts(good.withColumn("subject", F.lit("ELA")))
