"""H and A13: feedback, rules, prompts."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.catalog.validation import _WS, item_rows
from itemspark.operators import ranks, rules
from itemspark.sources import sinks

KEYS = "standard, difficulty, type"
THEMES = [
    (["of the", "zzqx"], "Avoid stock phrases."), (["zzqy"], "Never met."), (["avec"], "Check the language."),
    (["only", "rely"], "Avoid absolute words."), (["of the "], "Avoid stock phrases."), (["and the"], "Shorten sentences."),
]

# every document is the remark on the score row of the same number
_ROWS = f"""r AS (SELECT e.ordinal, e.standard, e.difficulty, e.type, e.score, CASE WHEN doc_id % 2 = 0 THEN text END AS suggestion,
  CASE WHEN doc_id % 5 <> 0 THEN text END AS reasoning FROM documents d JOIN [eval_rows] e ON e.ordinal = d.doc_id),
f AS (SELECT ordinal, {KEYS}, suggestion, reasoning FROM r WHERE score IS NULL OR score < 0.85),
s AS (SELECT ordinal, {KEYS}, regexp_replace(regexp_replace(coalesce(suggestion, reasoning), '{_WS}', ' ', 'g'), '^ | $', '', 'g') AS rule FROM f WHERE coalesce(suggestion, reasoning) IS NOT NULL)"""


def feedback(d):
    docs = d.table("documents").select(
        F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("suggestion"),
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("reasoning"), F.lit(None).cast("string").alias("internal_reasoning"),
    )
    rows = docs.join(d.view("eval_rows").select("ordinal", "standard", "difficulty", "type", "score"), "ordinal")
    return rules.failure_feedback(rows, reason_chars=None)


def _stripped(col):
    return f"nullif(regexp_replace({col}, '^{_WS}|{_WS}$', '', 'g'), '')"


@query("h1_failure_feedback", f"WITH {_ROWS} SELECT ordinal, {KEYS}, {_stripped('suggestion')} AS suggestion, reasoning FROM f")
def _(d):
    return feedback(d)


_HITS = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{rule}' AS rule WHERE EXISTS (SELECT 1 FROM s WHERE {' OR '.join(f'contains(lower(s.rule), {chr(39)}{k}{chr(39)})' for k in keys)})"
    for i, (keys, rule) in enumerate(THEMES)
)


@query("h2_theme_rules", f"WITH {_ROWS}, h AS ({_HITS}) SELECT CAST(min(pos) AS BIGINT) AS pos, rule FROM h GROUP BY rule")
def _(d):
    return rules.theme_rules(feedback(d), THEMES)


@query("h2_dimension_theme_rules", """
WITH q AS (SELECT lang AS dim, lower(text) AS t FROM documents)
SELECT 0::BIGINT AS pos, 'en' AS dim, 'Plain words.' AS rule WHERE EXISTS (SELECT 1 FROM q WHERE dim = 'en' AND contains(t, 'the'))
UNION ALL SELECT 1, 'fr', 'Check accents.' WHERE EXISTS (SELECT 1 FROM q WHERE dim = 'fr' AND (contains(t, 'zzqx') OR contains(t, 'é')))
UNION ALL SELECT 2, 'fr', 'Never met.' WHERE EXISTS (SELECT 1 FROM q WHERE dim = 'fr' AND contains(t, 'zzqx'))""")
def _(d):
    themes = {"en": [(["the"], "Plain words.")], "fr": [(["zzqx", "é"], "Check accents."), (["zzqx"], "Never met.")]}
    return rules.dimension_theme_rules(d.table("documents").select(F.col("lang").alias("dim"), F.col("text").alias("reasoning")), themes)


_KEYED = f"""x AS (SELECT DISTINCT standard, difficulty FROM [items]),
u AS (SELECT standard, ordinal, rule FROM s UNION ALL SELECT p.standard, -1 - p.rule_no, p.rule FROM (SELECT standard, pos AS rule_no, rule FROM [rules] WHERE scope = 'standard') p
  WHERE p.standard IN (SELECT standard FROM f)),
a AS (SELECT 'standard' AS scope, standard, CAST(NULL AS VARCHAR) AS difficulty, CAST(NULL AS VARCHAR) AS type, row_number() OVER (PARTITION BY standard ORDER BY first_at, rule) - 1 AS pos, rule
  FROM (SELECT standard, rule, min(ordinal)  AS first_at FROM u GROUP BY ALL)),
b AS (SELECT 'standard_difficulty' AS scope, {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY first_at, rule) - 1 AS pos, rule
  FROM (SELECT {KEYS}, rule, min(ordinal)  AS first_at FROM s WHERE EXISTS (SELECT 1 FROM x WHERE x.standard = s.standard AND x.difficulty = s.difficulty) GROUP BY ALL)),
k AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def _keyed(d):
    specific = d.view("rules").filter("scope = 'standard'").select("standard", F.col("pos").alias("rule_no"), "rule")
    return rules.keyed_rules(feedback(d), d.view("items"), specific)


@query("h3_keyed_rules", f"WITH {_ROWS}, {_KEYED} SELECT * FROM k")
def _(d):
    return _keyed(d)


@query("h4_merge_rules", f"""
WITH o AS (SELECT scope, CASE WHEN scope <> 'global' THEN standard END AS standard, CASE WHEN scope = 'standard_difficulty' THEN difficulty END AS difficulty,
  CASE WHEN scope = 'standard_difficulty' THEN type END AS type, pos, rule FROM [rules]),
n AS (SELECT scope, standard, difficulty, type, pos, upper(rule) AS rule FROM o WHERE pos % 3 = 0 UNION ALL SELECT scope, standard, difficulty, type, pos + 100000, concat(rule, ' again') FROM o WHERE pos % 5 = 0),
t AS (SELECT DISTINCT scope, standard, difficulty, type FROM n UNION SELECT DISTINCT scope, standard, difficulty, type FROM o WHERE scope = 'global'),
u AS (SELECT *, 0 AS src FROM o WHERE EXISTS (SELECT 1 FROM t WHERE t.scope = o.scope AND t.standard IS NOT DISTINCT FROM o.standard AND t.difficulty IS NOT DISTINCT FROM o.difficulty AND t.type IS NOT DISTINCT FROM o.type)
  UNION ALL SELECT *, 1 FROM n),
g AS (SELECT scope, standard, difficulty, type, lower(trim(rule)) AS same, min(src * 1000000000 + pos) AS first_at,
  coalesce(arg_max(rule, pos) FILTER (WHERE src = 0), arg_min(rule, pos) FILTER (WHERE src = 1)) AS rule FROM u GROUP BY ALL)
SELECT scope, standard, difficulty, type, row_number() OVER (PARTITION BY scope, standard, difficulty, type ORDER BY first_at) - 1 AS pos, rule FROM g
UNION ALL SELECT scope, standard, difficulty, type, pos, rule FROM o WHERE NOT EXISTS
  (SELECT 1 FROM t WHERE t.scope = o.scope AND t.standard IS NOT DISTINCT FROM o.standard AND t.difficulty IS NOT DISTINCT FROM o.difficulty AND t.type IS NOT DISTINCT FROM o.type)""")
def _(d):
    old = _placed(d)
    new = old.filter("pos % 3 = 0").withColumn("rule", F.upper("rule")).unionByName(
        old.filter("pos % 5 = 0").withColumns({"pos": F.col("pos") + 100000, "rule": F.concat("rule", F.lit(" again"))})
    )
    return rules.merge_rules(old, new)


def _placed(d):
    """Stored rules whose key columns are null where their scope has none."""
    r = d.view("rules")
    full = F.col("scope") == "standard_difficulty"
    return r.select(
        "scope", F.when(F.col("scope") != "global", F.col("standard")).alias("standard"), F.when(full, F.col("difficulty")).alias("difficulty"),
        F.when(full, F.col("type")).alias("type"), "pos", "rule",
    )


def merged_rules(d):
    """The rule store as a merge leaves it: distinct rules, in order."""
    return rules.merge_rules(_placed(d), _placed(d))


_STREAKS = f"""q AS (SELECT {KEYS}, ordinal, score FROM [eval_rows] WHERE score IS NOT NULL),
lp AS (SELECT {KEYS}, max(ordinal) AS lp FROM q WHERE score >= 0.95 GROUP BY ALL),
st AS (SELECT q.standard, q.difficulty, q.type, count(*) AS streak FROM q LEFT JOIN lp USING ({KEYS}) WHERE lp IS NULL OR ordinal > lp GROUP BY ALL HAVING count(*) >= 3),
fi AS (SELECT {KEYS}, min(ordinal) AS ordinal FROM [items] WHERE question IS NOT NULL AND question <> '' GROUP BY ALL),
ng AS (SELECT st.standard, st.difficulty, st.type, st.streak, i.question AS bad_question, i.answer AS bad_answer FROM st JOIN fi USING ({KEYS}) JOIN [items] i ON i.ordinal = fi.ordinal)"""


def _negatives(d):
    streaks = ranks.failing_streaks(d.view("eval_rows"), passing=0.95)
    # score rows carry short standards
    streaks = streaks.withColumn("standard", F.replace("standard", F.lit("CCSS.ELA-LITERACY."), F.lit("")))
    return rules.inject_negatives(streaks, d.view("items"), _placed(d), question_chars=None)


@query("h5_inject_negatives", f"WITH {_STREAKS} SELECT {KEYS}, streak, bad_question, bad_answer FROM ng")
def _(d):
    return _negatives(d)[0].select("standard", "difficulty", "type", "streak", "bad_question", "bad_answer")


@query("h5_front_rules", f"""WITH {_STREAKS} SELECT {KEYS}, count(*) AS n FROM (SELECT {KEYS} FROM ng UNION ALL SELECT {KEYS} FROM [rules] WHERE scope = 'standard_difficulty') GROUP BY ALL""")
def _(d):
    out = _negatives(d)[1].filter("scope = 'standard_difficulty'")
    return out.groupBy("standard", "difficulty", "type").agg(F.count(F.lit(1)).alias("n"))


@query("h5_clear_resolved", f"""
SELECT n.standard, n.difficulty, n.type, n.bad_ordinal, n.streak FROM [negatives] n WHERE NOT EXISTS
  (SELECT 1 FROM [eval_rows] e WHERE e.score >= 0.85 AND e.standard = n.standard AND e.difficulty = n.difficulty AND e.type = n.type)""")
def _(d):
    return rules.clear_resolved(d.view("negatives"), d.view("eval_rows"))


def prompts(d):
    items = d.view("items")
    seeds = rules.examples_to_seed(
        item_rows(d).join(d.view("eval_rows").select("ordinal", "score"), "ordinal").filter("score >= 0.95"), "3"
    )
    negatives = d.view("negatives").withColumn("bad_question", F.concat(F.lit("row "), F.col("bad_ordinal").cast("string"))).withColumn("bad_answer", F.lit("A"))
    standards = items.groupBy("standard").agg(F.min("question").alias("standard_description"))
    return rules.build_prompts(items.select("standard", "difficulty", "type"), standards, merged_rules(d), negatives.drop("bad_ordinal"), seeds)


_PROMPT_FACTS = f"""
WITH p AS (SELECT DISTINCT {KEYS} FROM [items]), x AS (SELECT i.ordinal, i.standard, i.difficulty, i.type FROM [items] i JOIN [eval_rows] e ON e.ordinal = i.ordinal WHERE e.score >= 0.95),
ex AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.standard = p.standard AND x.difficulty = p.difficulty AND x.type = p.type) THEN (SELECT count(*) FROM x WHERE x.standard = p.standard AND x.difficulty = p.difficulty AND x.type = p.type)
  WHEN EXISTS (SELECT 1 FROM x WHERE x.standard = p.standard AND x.type = p.type) THEN (SELECT count(*) FROM x WHERE x.standard = p.standard AND x.type = p.type) ELSE 2 END AS n FROM p),
ru AS (SELECT p.*, (SELECT count(DISTINCT lower(rule)) FROM [rules] r WHERE r.scope = 'standard' AND r.standard = p.standard) + (SELECT count(DISTINCT lower(rule)) FROM [rules] r WHERE r.scope = 'standard_difficulty' AND r.standard = p.standard AND r.difficulty = p.difficulty AND r.type = p.type) AS n FROM p)
SELECT p.standard, p.difficulty, p.type, least(ex.n, 2) AS n_examples, ru.n AS n_rules, (SELECT streak FROM [negatives] n WHERE n.standard = p.standard AND n.difficulty = p.difficulty AND n.type = p.type) AS streak
FROM p JOIN ex USING ({KEYS}) JOIN ru USING ({KEYS})"""


@query("h6_build_prompts", _PROMPT_FACTS)
def _(d):
    got = prompts(d)
    streak = F.nullif(F.regexp_extract("user_prompt", r"scored too low (\d+) times\)", 1), F.lit("")).cast("long")
    shown = F.size(F.split("system_prompt", r"(?m)^### Sample \d+\nRequest: ")) - 1
    return got.select("standard", "difficulty", "type", shown.cast("long").alias("n_examples"), "n_rules", streak.alias("streak"))


@query("h7_examples_to_seed", """
SELECT ordinal, concat('Write one ', type, ' question for Grade 3 ELA.', chr(10), 'Standard: ', standard, chr(10), 'Difficulty: ', difficulty) AS user_prompt, answer, opt_a AS first_option FROM [items]""")
def _(d):
    got = rules.examples_to_seed(item_rows(d).withColumn("score", F.lit(1.0)), "3")
    get = lambda p: F.get_json_object("example_json", p)
    return got.select("ordinal", "user_prompt", get("$.answer").alias("answer"), get("$.answer_options[0].text").alias("first_option"))


@query("a13_export_prompt_bundle", f"SELECT DISTINCT {KEYS}, concat(standard, '|', difficulty, '|', type) AS key, true AS has_user FROM [items]")
def _(d):
    got = sinks.export_prompt_bundle(prompts(d))
    get = lambda p: F.get_json_object("value", p)
    return got.select("standard", "difficulty", "type", get("$.key").alias("key"), (F.length(get("$.user")) > 0).alias("has_user"))
