"""E and S: joins and set operations."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.operators import aggs, joins, ranks

KEYS = "standard, difficulty, type"


@query("e1_join_items_results", """
SELECT i.ordinal, i.standard, i.type, coalesce(CASE WHEN e.ordinal % 2 = 0 THEN e.score END, e.score) AS score
FROM [items] i LEFT JOIN [eval_rows] e ON e.ordinal = i.ordinal""")
def _(d):
    results = d.view("eval_rows").select(
        "ordinal", F.when(F.col("ordinal") % 2 == 0, F.col("score")).alias("list_score"), F.col("score").alias("nested_score")
    )
    return joins.join_items_results(d.view("items").select("ordinal", "standard", "type"), results)


@query("e2_failed_keys", "SELECT DISTINCT standard, difficulty FROM [eval_rows] WHERE score IS NULL OR score < 0.85")
def _(d):
    return joins.failed_keys(d.view("eval_rows"))


@query("e3_scored_item_join", """
SELECT g.question_id, r.standard, g.question_type, json_extract_string(g.response, '$.difficulty') AS difficulty, a.score, g.response, r.standard_desc
FROM [generated] g JOIN [recipes] r ON g.recipe_id = r.recipe_id JOIN [question_scores] a ON a.question_id = g.question_id
WHERE r.subject IN ('ela', 'language', 'reading') AND r.grade_level = '3' AND r.standard LIKE 'CCSS.ELA-LITERACY%'
  AND g.question_type IN ('mcq', 'msq', 'fill-in') AND json_extract_string(g.response, '$.difficulty') IN ('easy', 'medium', 'hard') AND a.score >= 0.85""")
def _(d):
    return joins.scored_item_join(
        d.view("generated"), d.view("recipes"), d.view("question_scores"), ["ela", "language", "reading"], "3"
    )


@query("e4_coverage_gap", """
WITH x AS (SELECT DISTINCT standard, difficulty FROM [items])
SELECT e.ordinal, e.standard, e.difficulty, e.score, x.standard IS NOT NULL AS has_example
FROM [eval_rows] e LEFT JOIN x ON x.standard = e.standard AND x.difficulty = e.difficulty WHERE e.score IS NULL OR e.score < 0.85""")
def _(d):
    rows = d.view("eval_rows").select("ordinal", "standard", "difficulty", "score")
    return joins.coverage_gap(rows, d.view("items"))


@query("e5_merge_by_rank", f"""
WITH cur AS (SELECT ordinal, {KEYS}, coalesce(score, 0) AS score FROM [eval_rows] WHERE round <= 10),
inc AS (SELECT ordinal, {KEYS}, score FROM [eval_rows] WHERE round > 10 AND score >= 0.85),
c AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY score DESC, ordinal) AS rank FROM cur),
n AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY score DESC, ordinal) AS rank FROM inc),
m AS (SELECT coalesce(c.standard, n.standard) AS standard, coalesce(c.difficulty, n.difficulty) AS difficulty, coalesce(c.type, n.type) AS type,
    c.ordinal AS co, n.ordinal AS no, c.score AS cs, n.score AS ns
  FROM (SELECT * FROM c WHERE rank <= 2) c FULL JOIN (SELECT * FROM n WHERE rank <= 2) n
    ON c.standard = n.standard AND c.difficulty = n.difficulty AND c.type = n.type AND c.rank = n.rank)
SELECT CASE WHEN no IS NOT NULL AND (co IS NULL OR ns > cs) THEN no ELSE co END AS ordinal, {KEYS},
  CASE WHEN no IS NOT NULL AND (co IS NULL OR ns > cs) THEN ns ELSE cs END AS score,
  CASE WHEN no IS NULL OR (co IS NOT NULL AND ns <= cs) THEN 'kept' WHEN co IS NULL THEN 'filled' ELSE 'replaced' END AS action FROM m
UNION ALL SELECT ordinal, {KEYS}, score, 'kept' FROM c WHERE rank > 2""")
def _(d):
    rows = d.view("eval_rows").select("ordinal", "standard", "difficulty", "type", "score", "round")
    return joins.merge_by_rank(rows.filter("round <= 10").drop("round"), rows.filter("round > 10").drop("round"))


@query("e6_replace_by_key", """
WITH n AS (SELECT ordinal, standard, difficulty, score FROM [eval_rows] WHERE round = 30 AND score >= 0.85),
x AS (SELECT ordinal, standard, difficulty, score FROM [eval_rows] WHERE round < 30)
SELECT * FROM n UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.standard = x.standard AND n.difficulty = x.difficulty)""")
def _(d):
    rows = d.view("eval_rows").select("ordinal", "standard", "difficulty", "score", "round")
    old, new = rows.filter("round < 30").drop("round"), rows.filter("round = 30 and score >= 0.85").drop("round")
    return joins.replace_by_key(old, new)


@query("e7_merge_partial_run", f"""
WITH b AS (SELECT ordinal, {KEYS}, score FROM [eval_rows] WHERE round < 30), n AS (SELECT ordinal, {KEYS}, score FROM [eval_rows] WHERE round = 30)
SELECT ordinal, {KEYS}, score, score IS NULL AS to_score FROM b
WHERE NOT EXISTS
  (SELECT 1 FROM n WHERE n.standard = b.standard AND n.difficulty = b.difficulty AND n.type = b.type)
UNION ALL SELECT ordinal, {KEYS}, NULL, true FROM n""")
def _(d):
    rows = d.view("eval_rows").select("ordinal", "standard", "difficulty", "type", "score", "round")
    return joins.merge_partial_run(rows.filter("round < 30").drop("round"), rows.filter("round = 30").drop("round"))


@query("e8_plan_cross", """
WITH s AS (SELECT DISTINCT standard FROM [items])
SELECT standard, CAST(t.p AS INT) AS type_pos, t.type, CAST(q.p AS INT) AS difficulty_pos, q.difficulty FROM s,
  (VALUES (0, 'mcq'), (1, 'msq'), (2, 'fill-in')) AS t(p, type), (VALUES (0, 'easy'), (1, 'medium'), (2, 'hard')) AS q(p, difficulty)""")
def _(d):
    return joins.plan_cross(d.view("items"))


@query("e9_lookup_standard", """
WITH k AS (SELECT DISTINCT concat('S.', CAST(l_partkey % 90 AS VARCHAR)) AS standard FROM lineitem),
c AS (SELECT standard_id AS standard, min(pos) AS pos, arg_min(standard_description, pos) AS d FROM [curriculum_blocks] GROUP BY standard_id),
f AS (SELECT concat('S.', CAST(s_suppkey AS VARCHAR)) AS standard, s_name AS d FROM supplier)
SELECT k.standard, c.pos, coalesce(nullif(c.d, ''), f.d) AS standard_description FROM k LEFT JOIN c USING (standard) LEFT JOIN f USING (standard)""")
def _(d):
    plan = d.table("lineitem").select(F.concat(F.lit("S."), (F.col("l_partkey") % 90).cast("string")).alias("standard")).distinct()
    first = ranks.dedupe_standards(d.view("curriculum_blocks")).select(
        F.col("standard_id").alias("standard"), "pos", "standard_description"
    )
    second = d.table("supplier").select(
        F.concat(F.lit("S."), F.col("s_suppkey").cast("string")).alias("standard"), F.col("s_name").alias("standard_description")
    )
    return joins.lookup_standard(plan, first, second)


_EXAMPLE_LEVELS = [("p.standard = x.standard AND p.difficulty = x.difficulty AND p.type = x.type", "standard, difficulty, type", "score DESC, ordinal"),
    ("p.standard = x.standard AND p.type = x.type", "standard, type", "score DESC, ordinal"),
    ("p.difficulty = x.difficulty AND p.type = x.type", "difficulty, type", "score DESC, ordinal"),
    ("p.type = x.type", "type", "score DESC, ordinal"),
    ("p.standard = x.standard AND p.difficulty = x.difficulty", "standard, difficulty", "ordinal")]
_FOUND = " UNION ALL ".join(
    f"SELECT p.standard, p.difficulty, p.type, {i} AS level, x.rank, x.ordinal, x.score FROM p JOIN "
    f"(SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rank FROM x) x ON {on} WHERE x.rank <= 2"
    for i, (on, part, order) in enumerate(_EXAMPLE_LEVELS, start=1)
)


@query("e10_retrieve_examples", f"""
WITH p AS (SELECT DISTINCT CASE WHEN ordinal % 11 = 0 THEN 'S.new' ELSE standard END AS standard, CASE WHEN ordinal % 7 = 0 THEN 'extra' ELSE difficulty END AS difficulty,
  CASE WHEN ordinal % 5 = 0 THEN 'open' ELSE type END AS type FROM [items]),
x AS (SELECT ordinal, {KEYS}, score FROM [eval_rows] WHERE score >= 0.95),
f AS ({_FOUND})
SELECT standard, difficulty, type, CAST(level AS BIGINT) AS level, rank, ordinal, score FROM f QUALIFY level = min(level) OVER (PARTITION BY {KEYS})""")
def _(d):
    own = lambda n, value, c: F.when(F.col("ordinal") % n == 0, value).otherwise(F.col(c)).alias(c)
    plan = d.view("items").select(own(11, "S.new", "standard"), own(7, "extra", "difficulty"), own(5, "open", "type"))
    examples = d.view("eval_rows").filter("score >= 0.95")
    got = joins.retrieve_examples(plan, examples.select("ordinal", "standard", "difficulty", "type", "score"))
    return got.select("standard", "difficulty", "type", "level", "rank", "ordinal", "score")


@query("e11_lookup_rules", f"""
WITH p AS (SELECT DISTINCT {KEYS} FROM [items])
SELECT p.*, 1::BIGINT AS part, r.pos, r.rule FROM p JOIN [rules] r ON r.scope = 'standard' AND r.standard = p.standard
UNION ALL SELECT p.*, 2, r.pos, r.rule FROM p JOIN [rules] r ON r.scope = 'standard_difficulty' AND r.standard = p.standard
  AND r.difficulty = p.difficulty AND r.type = p.type""")
def _(d):
    return joins.lookup_rules(d.view("items"), d.view("rules"))


_CHANGE = """c AS (SELECT o.ordinal, o.score AS old_score, n.score AS new_score,
  CASE WHEN n.score IS NULL THEN 'missing' WHEN n.score - o.score > 0.01 THEN 'improved' WHEN n.score - o.score < -0.01 THEN 'degraded' ELSE 'unchanged' END AS change
  FROM [eval_rows] o LEFT JOIN n ON n.ordinal = o.ordinal WHERE o.score < 0.85)"""
_RERUN = "n AS (SELECT ordinal - 1 AS ordinal, score FROM [eval_rows] WHERE ordinal > 0)"


def _rerun(d):
    rows = d.view("eval_rows")
    again = rows.filter("ordinal > 0").select((F.col("ordinal") - 1).alias("ordinal"), "score")
    return rows, joins.compare_runs(rows.filter("score < 0.85"), again)


@query("e12_compare_runs", f"WITH {_RERUN}, {_CHANGE} SELECT *, change = 'improved' AND new_score >= 0.85 AS newly_passed FROM c")
def _(d):
    return _rerun(d)[1]


@query("e13_apply_improvements", f"""
WITH {_RERUN}, {_CHANGE}, z AS (SELECT coalesce(CASE WHEN change = 'improved' AND new_score >= 0.85 THEN new_score END, e.score) AS score
  FROM [eval_rows] e LEFT JOIN c ON c.ordinal = e.ordinal)
SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.85) AS pass_count,
  round(CAST(100 * count(*) FILTER (WHERE score >= 0.85) AS DOUBLE) / count(*), 1) AS pass_rate FROM z""")
def _(d):
    rows, change = _rerun(d)
    return joins.pass_rate_over_all(joins.apply_improvements(rows, change))


_PRICED = """c AS (SELECT call_id, prompt_tokens - cache_hit_tokens AS miss, cache_hit_tokens AS hit, completion_tokens AS outp,
  CASE call_id % 4 WHEN 0 THEN 'fireworks' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'deepseek' ELSE 'local' END AS provider,
  CASE call_id % 4 WHEN 0 THEN CASE WHEN model = 'm0' THEN 'fw/glm-5' ELSE 'fw/other' END WHEN 1 THEN CASE WHEN model = 'm1' THEN 'or/gpt-4.1' ELSE 'or/other' END
    WHEN 2 THEN CASE WHEN model = 'm2' THEN 'deepseek-reasoner' ELSE 'deepseek-chat' END ELSE 'local' END AS model FROM [token_usage]),
p AS (SELECT *, CASE model WHEN 'fw/glm-5' THEN 0.5 WHEN 'fw/other' THEN 0.28 WHEN 'or/gpt-4.1' THEN 1 WHEN 'or/other' THEN 0.2 WHEN 'deepseek-reasoner' THEN 1
    WHEN 'deepseek-chat' THEN 0.5 ELSE 0 END AS p0,
  CASE model WHEN 'fw/glm-5' THEN 1 WHEN 'fw/other' THEN 0.56 WHEN 'or/gpt-4.1' THEN 2 WHEN 'or/other' THEN 0.4 WHEN 'deepseek-reasoner' THEN 4 WHEN 'deepseek-chat' THEN 2 ELSE 0 END AS p1,
  CASE model WHEN 'fw/glm-5' THEN 3.2 WHEN 'fw/other' THEN 1.68 WHEN 'or/gpt-4.1' THEN 8 WHEN 'or/other' THEN 1 WHEN 'deepseek-reasoner' THEN 16 WHEN 'deepseek-chat' THEN 8 ELSE 0 END AS p2 FROM c)"""


def _calls(d):
    other = F.col("model")
    mod = F.col("call_id") % 4
    provider = F.when(mod == 0, "fireworks").when(mod == 1, "openrouter").when(mod == 2, "deepseek").otherwise("local")
    model = (
        F.when(mod == 0, F.when(other == "m0", "fw/glm-5").otherwise("fw/other"))
        .when(mod == 1, F.when(other == "m1", "or/gpt-4.1").otherwise("or/other"))
        .when(mod == 2, F.when(other == "m2", "deepseek-reasoner").otherwise("deepseek-chat")).otherwise("local")
    )
    return d.view("token_usage").select(
        "call_id", provider.alias("provider"), model.alias("model"), "prompt_tokens", "completion_tokens", "cache_hit_tokens",
        F.expr("prompt_tokens - cache_hit_tokens").alias("cache_miss_tokens"),
    )


@query("e14_usage_with_price", f"""
WITH {_PRICED} SELECT call_id, provider, model, round(CAST(hit * p0 + miss * p1 + outp * p2 AS DOUBLE) / 1000000, 8) AS cost,
  CASE provider WHEN 'deepseek' THEN 'CNY' ELSE 'USD' END AS currency FROM p""")
def _(d):
    got = joins.usage_with_price(_calls(d))
    return got.select("call_id", "provider", "model", F.round(F.col("cost").cast("double"), 8).alias("cost"), "currency")


@query("f15_usage_cost", f"""
WITH {_PRICED} SELECT provider, count(*) AS calls, round(CAST(sum(hit * p0 + miss * p1 + outp * p2) AS DOUBLE) / 1000000, 6) AS cost FROM p GROUP BY provider""")
def _(d):
    got = aggs.usage_totals(joins.usage_with_price(_calls(d)), by=["provider"])
    return got.select("provider", "calls", F.round(F.col("cost").cast("double"), 6).alias("cost"))


@query("e15_backfill_type", """
SELECT e.ordinal, coalesce(CASE WHEN e.ordinal % 3 = 0 THEN e.type END, i.type, 'mcq') AS type FROM [eval_rows] e LEFT JOIN [items] i ON i.ordinal = e.ordinal""")
def _(d):
    details = d.view("eval_rows").select("ordinal", F.when(F.col("ordinal") % 3 == 0, F.col("type")).alias("type"))
    return joins.backfill_type(details, d.view("items"))


@query("d17_filter_plan", """
WITH s AS (SELECT DISTINCT standard FROM [items]), p AS (SELECT s.standard, t.type, q.difficulty FROM s, (VALUES ('mcq'), ('msq'), ('fill-in')) AS t(type), (VALUES ('easy'), ('hard')) AS q(difficulty)),
f AS (SELECT DISTINCT replace(standard, 'CCSS.ELA-LITERACY.', '') AS short, difficulty, type FROM [eval_rows] WHERE score < 0.85),
w AS (SELECT type, difficulty FROM [eval_rows] WHERE score IS NOT NULL GROUP BY type, difficulty
  HAVING round(CAST(100 * sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1) < 83)
SELECT standard, difficulty, type FROM p WHERE EXISTS (SELECT 1 FROM f WHERE f.short = replace(p.standard, 'CCSS.ELA-LITERACY.', '') AND f.difficulty = p.difficulty AND f.type = p.type)
  AND EXISTS (SELECT 1 FROM w WHERE w.type = p.type AND w.difficulty = p.difficulty)""")
def _(d):
    rows = d.view("eval_rows")
    plan = joins.plan_cross(d.view("items")).select("standard", "difficulty", "type")
    return joins.filter_plan(plan, ["easy", "hard", "unheard"], failed=rows.filter("score < 0.85"), weak=aggs.weak_combos(rows, 83))


@query("d15_check_grade_subject", """
WITH p AS (SELECT DISTINCT grade, subject_abbr FROM [curriculum_blocks]),
k AS (SELECT DISTINCT CAST(1 + user_id % 13 AS VARCHAR) AS grade, CASE user_id % 4 WHEN 0 THEN 'ELA' WHEN 1 THEN 'READ' WHEN 2 THEN 'MATH' ELSE 'ART' END AS subject FROM events),
a AS (SELECT *, CASE grade WHEN '9' THEN '10' WHEN '12' THEN '11' ELSE grade END AS g FROM k)
SELECT grade, subject, CASE WHEN g NOT IN (SELECT grade FROM p) THEN 'unknown_grade' WHEN subject NOT IN (SELECT subject_abbr FROM p) THEN 'unknown_subject'
  WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.grade = a.g AND p.subject_abbr = a.subject) THEN 'unknown_pair' END AS reason FROM a""")
def _(d):
    who = F.col("user_id") % 4
    asked = d.table("events").select(
        (1 + F.col("user_id") % 13).cast("string").alias("grade"),
        F.when(who == 0, "ELA").when(who == 1, "READ").when(who == 2, "MATH").otherwise("ART").alias("subject"),
    ).distinct()
    return aggs.grade_subject_reason(asked, d.view("curriculum_blocks"))


@query("s1_union_all", """
SELECT 'items' AS source, ordinal, standard, CAST(NULL AS DOUBLE) AS score FROM [items] UNION ALL SELECT 'eval', ordinal, standard, score FROM [eval_rows]""")
def _(d):
    a = d.view("items").select(F.lit("items").alias("source"), "ordinal", "standard")
    return joins.union_all(a, d.view("eval_rows").select(F.lit("eval").alias("source"), "ordinal", "standard", "score"))


_SETS = "SELECT standard, difficulty FROM [eval_rows] WHERE score < 0.85 {op} SELECT standard, difficulty FROM [items]"


@query("s2_keys_in_both", _SETS.format(op="INTERSECT"))
def _(d):
    return joins.keys_in_both(d.view("eval_rows").filter("score < 0.85"), d.view("items"))


@query("s2_keys_only_in_first", _SETS.format(op="EXCEPT"))
def _(d):
    return joins.keys_only_in_first(d.view("eval_rows").filter("score < 0.85"), d.view("items"))


@query("s3_distinct_keys", "SELECT DISTINCT standard, difficulty, type FROM [eval_rows]")
def _(d):
    return joins.distinct_keys(d.view("eval_rows"), ["standard", "difficulty", "type"])
