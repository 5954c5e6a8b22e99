"""D: validation, fixing, completing."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.functions import options
from itemspark.functions import fixed_values as V
from itemspark.operators import bank, joins, mend, validate
from itemspark.skew import settle


def item_rows(d):
    """The items view with its options as a map and its accepted answers as an array."""
    wide = d.view("items")
    accepted = F.when(F.col("acceptable_1").isNotNull(), F.array("acceptable_1"))
    return settle(wide.withColumn(
        "answer_options", options.from_wide(F.col("opt_a"), F.col("opt_b"), F.col("opt_c"), F.col("opt_d"))
    ).withColumn("acceptable_answers", accepted).drop("opt_a", "opt_b", "opt_c", "opt_d", "acceptable_1"))


def _any(col, needles):
    return "(" + " OR ".join(f"contains({col}, '{n}')" for n in needles) + ")"


_CHOICE_MISSING = "concat_ws(',', CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END, CASE WHEN answer_explanation IS NULL THEN 'answer_explanation' END)"
_FILL_MISSING = "concat_ws(',', CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END, CASE WHEN answer_explanation IS NULL THEN 'answer_explanation' END)"
_OPTS = "lower(concat_ws(' ', opt_a, opt_b, opt_c, opt_d))"
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# words next to the blank, in the views the stem ends with the blank
_GIVEAWAY = f"""contains(concat(' ', regexp_replace(regexp_replace(lower(array_to_string(list_slice(list_filter(regexp_split_to_array(split_part(question, '______', 1), '{_WS}'), lambda x: x <> ''), -2, -1), ' ')),
   '\\([^)]*\\)', ' ', 'g'), '[,;:!?.''"*\\[\\]]', ' ', 'g'), ' '), concat(' ', lower(answer), ' '))"""
_REJECT = f"""CASE
  WHEN {_any(_OPTS, ['matches the standard'])} OR (contains({_OPTS}, 'correct choice') AND contains({_OPTS}, 'distractor')) OR (contains({_OPTS}, 'a correct') AND contains({_OPTS}, 'an incorrect')) THEN 'placeholder'
  WHEN type = 'fill-in' THEN CASE
    WHEN {_FILL_MISSING} <> '' THEN concat('missing_fields:', {_FILL_MISSING})
    WHEN answer = '' THEN 'blank_answer'
    WHEN NOT {_any('lower(question)', V.BLANK_CUES)} THEN 'no_blank_cue'
    WHEN lower(answer) <> acceptable_1 THEN 'answer_not_accepted'
    WHEN contains(question, '______') AND length(answer) > 2 AND {_GIVEAWAY} THEN 'answer_beside_blank' END
  WHEN opt_d IS NULL THEN coalesce(CASE WHEN {_CHOICE_MISSING} <> '' THEN concat('missing_fields:', {_CHOICE_MISSING}) END, 'option_keys')
  WHEN {_CHOICE_MISSING} <> '' THEN concat('missing_fields:', {_CHOICE_MISSING})
  WHEN type = 'msq' THEN CASE WHEN answer = 'B' THEN 'too_few_answers' END
  WHEN answer = 'E' THEN 'answer_letter' END"""


@query("d1_validate_schema", f"SELECT ordinal, {_REJECT} AS reject_reason FROM [items]")
def _(d):
    return validate.validate_schema(item_rows(d)).select("ordinal", "reject_reason")


@query("d1_reject_counts", f"SELECT type, {_REJECT} AS reject_reason, count(*) AS n FROM [items] GROUP BY ALL")
def _(d):
    return validate.validate_schema(item_rows(d)).groupBy("type", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


_HAND_OUT = """h AS (SELECT doc_id AS ordinal, CASE doc_id % 4 WHEN 0 THEN concat('the correct choice: ', text) WHEN 1 THEN concat('A correct answer: ', text) ELSE text END AS a,
  CASE doc_id % 3 WHEN 0 THEN 'a distractor' WHEN 1 THEN 'an incorrect answer' ELSE 'matches the Standard' END AS b FROM documents)"""


@query("d2_placeholder", f"""
WITH {_HAND_OUT}, l AS (SELECT ordinal, lower(concat(a, ' ', b)) AS t FROM h)
SELECT ordinal, (contains(t, 'correct choice') AND contains(t, 'distractor')) OR contains(t, 'matches the standard') OR (contains(t, 'a correct') AND contains(t, 'an incorrect'))
  OR (contains(t, 'correct answer') AND contains(t, 'incorrect answer') AND len(string_split(t, 'correct answer')) > 2) AS placeholder FROM l""")
def _(d):
    mod4, mod3 = F.col("doc_id") % 4, F.col("doc_id") % 3
    a = F.when(mod4 == 0, F.concat(F.lit("the correct choice: "), "text")).when(mod4 == 1, F.concat(F.lit("A correct answer: "), "text")).otherwise(F.col("text"))
    b = F.when(mod3 == 0, "a distractor").when(mod3 == 1, "an incorrect answer").otherwise("matches the Standard")
    rows = d.table("documents").withColumn("answer_options", F.create_map(F.lit("A"), a, F.lit("B"), b))
    return rows.select(F.col("doc_id").alias("ordinal"), validate.is_placeholder().alias("placeholder"))


_READING = "p AS (SELECT doc_id AS ordinal, concat(CASE WHEN doc_id % 2 = 0 THEN 'Read the passage. ' ELSE 'Think. ' END, text) AS question, concat('CCSS.ELA-LITERACY.', CASE doc_id % 3 WHEN 0 THEN 'RL.3.1' WHEN 1 THEN 'RI.4.2' ELSE 'W.5.1' END) AS standard FROM documents)"


@query("d4_passage_present", f"""
WITH {_READING}, q AS (SELECT ordinal, standard, lower(question) AS ql,
  len(list_filter(regexp_split_to_array(array_to_string(list_filter(list_transform(string_split(question, chr(10)), lambda s: regexp_replace(s, '^{_WS}|{_WS}$', '', 'g')),
    lambda s: s <> '' AND NOT contains(s, '______') AND NOT starts_with(s, '**')), ' '), '{_WS}'), lambda w: w <> '')) AS n FROM p)
SELECT ordinal, (standard LIKE '%.RL%' OR standard LIKE '%.RI%') AND {_any('ql', V.PASSAGE_CUES)} AND n < 20 AS passage_missing FROM q""")
def _(d):
    mod3 = F.col("doc_id") % 3
    stem = F.concat(F.when(F.col("doc_id") % 2 == 0, "Read the passage. ").otherwise("Think. "), F.col("text"))
    standard = F.concat(F.lit(V.STANDARD_PREFIX), F.when(mod3 == 0, "RL.3.1").when(mod3 == 1, "RI.4.2").otherwise("W.5.1"))
    rows = d.table("documents").select(F.col("doc_id").alias("ordinal"), stem.alias("_q"), F.lower(stem).alias("_ql"), standard.alias("standard"))
    return rows.select("ordinal", validate.passage_missing().alias("passage_missing"))


# answers are words of the text itself, so all are found; every second one is altered
_INSTRUCTION = " OR ".join(f"starts_with(lower(x), '{s}')" for s in V.INSTRUCTION_STARTS)


@query("d3_passage_membership", f"""
WITH t AS (SELECT doc_id AS ordinal, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS w, text FROM documents),
l AS (SELECT ordinal, w, list_transform(string_split(concat('Which word from the text fits?', chr(10), w, chr(10), text), chr(10)),
        lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')) AS ls FROM t),
p AS (SELECT ordinal, w, concat(' ', regexp_replace(concat(' ', array_to_string(list_transform(list_filter(ls, lambda x: x <> '' AND NOT ({_INSTRUCTION}) AND NOT starts_with(x, '**')),
        lambda x: regexp_replace(lower(regexp_replace(x, '__{{2,}}', ' ', 'g')), '{V.PUNCTUATION.replace("'", "''")}', ' ', 'g')), ' ')), '{_WS}', ' ', 'g'), ' ') AS passage FROM l)
SELECT ordinal, w <> '' AND length(passage) > 40 AND ordinal % 2 = 1 AS not_in_passage FROM p""")
def _(d):
    docs = d.table("documents")
    word = F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))
    entry = F.when(word == "", F.lit("")).when(F.col("doc_id") % 2 == 1, F.concat(word, F.lit("qzxv"))).otherwise(word)
    # a line of its own keeps the word whole once punctuation is blanked
    stem = F.concat(F.lit("Which word from the text fits?\n"), word, F.lit("\n"), F.col("text"))
    rows = docs.select(
        F.col("doc_id").alias("ordinal"), stem.alias("_q"), F.lower(stem).alias("_ql"),
        F.lit("CCSS.ELA-LITERACY.RL.3.1").alias("standard"), F.array(entry).alias("acceptable_answers"),
    )
    return rows.select("ordinal", validate.answer_not_in_passage().alias("not_in_passage"))


@query("d5_answer_giveaway", f"""
WITH i AS (SELECT doc_id AS ordinal, concat(text, CASE WHEN doc_id % 2 = 0 THEN ' zebra ______.' ELSE ' ______ zebra.' END, CASE WHEN doc_id % 3 = 0 THEN ' Word bank: zebra' ELSE '' END) AS question FROM documents)
SELECT ordinal, NOT regexp_matches(regexp_replace(question, '[*_]', '', 'g'), '(?is)word\\s*bank\\s*:\\s*zebra') AS beside FROM i""")
def _(d):
    blank = F.when(F.col("doc_id") % 2 == 0, " zebra ______.").otherwise(" ______ zebra.")
    offer = F.when(F.col("doc_id") % 3 == 0, " Word bank: zebra").otherwise("")
    rows = d.table("documents").select(
        F.col("doc_id").alias("ordinal"), F.concat("text", blank, offer).alias("_q"), F.lit("Zebra").alias("_ans")
    )
    return rows.select("ordinal", validate.answer_beside_blank().alias("beside"))


_QUALITY = f"""list_filter([
   CASE WHEN type = 'msq' AND NOT {_any('ql', V.MULTI_SELECT_CUES)} THEN 'msq_stem_missing_multi_select_instruction' END,
   CASE WHEN type = 'msq' AND dup THEN 'duplicate_option_text' END,
   CASE WHEN type = 'mcq' AND contains(ql, 'which word') AND correct LIKE '% %' THEN 'stem_says_word_but_answer_is_phrase' END,
   CASE WHEN {_any('ql', V.IMAGE_CUES)} THEN 'stem_references_image_but_no_image_url' END,
   CASE WHEN type = 'mcq' AND {_any('ql', V.PLURAL_STEMS)} AND {_any('ql', V.PLURAL_CLAIMS)} THEN 'stem_says_choices_plural_may_imply_multiple_answers' END,
   CASE WHEN type = 'mcq' AND dup THEN 'duplicate_option_text' END], lambda x: x IS NOT NULL)"""


def _strip_sql(col):
    return f"regexp_replace({col}, '^{_WS}|{_WS}$', '', 'g')"


_ISSUES = f"""v AS (SELECT *, {_REJECT} AS reason, lower(question) AS ql, CASE upper(answer) WHEN 'A' THEN opt_a WHEN 'B' THEN opt_b WHEN 'C' THEN opt_c ELSE opt_d END AS correct,
   len(list_distinct([{_strip_sql('opt_a')}, {_strip_sql('opt_b')}, {_strip_sql('opt_c')}, {_strip_sql('opt_d')}])) < 4 AS dup FROM [items]),
 q AS (SELECT *, CASE WHEN reason IS NOT NULL THEN [reason] ELSE {_QUALITY} END AS issues FROM v)"""


# the explanation always holds the whole text, so it always names the right option
@query("d6_quality_issues", f"WITH {_ISSUES} SELECT ordinal, array_to_string(issues, ';') AS issues FROM q")
def _(d):
    return validate.quality_issues(item_rows(d)).select("ordinal", F.array_join("issues", ";").alias("issues"))


@query("d13_validation_report", f"""
WITH {_ISSUES}, e AS (SELECT 'total' AS label FROM q UNION ALL SELECT CASE WHEN len(issues) = 0 THEN 'passed' ELSE 'failed' END FROM q
  UNION ALL SELECT concat('issue:', unnest(issues)) FROM q)
SELECT label, count(*) AS n FROM e GROUP BY label""")
def _(d):
    return validate.validation_report(item_rows(d))


@query("d13_failing_items", f"WITH {_ISSUES} SELECT ordinal, id, standard, array_to_string(issues, ';') AS issues FROM q WHERE len(issues) > 0")
def _(d):
    return validate.failing_items(item_rows(d)).withColumn("issues", F.array_join("issues", ";"))


@query("d7_auto_fix", f"""
WITH {_ISSUES}, a AS (SELECT ordinal, type, issues, CASE WHEN type <> 'fill-in' AND list_contains(issues, 'stem_says_choices_plural_may_imply_multiple_answers')
    THEN regexp_replace(replace(question, 'Which choices', 'Which choice'), 'correctly complete\\b', 'correctly completes', 'gi') ELSE question END AS question FROM q),
b AS (SELECT *, {_strip_sql(f"regexp_replace(regexp_replace(question, '(?i)[.]?[{chr(92)}s]*Look at the picture[^.]*[.]?', '. ', 'g'), '{_WS}', ' ', 'g')")} AS cut FROM a)
SELECT ordinal, CASE WHEN type <> 'fill-in' AND list_contains(issues, 'stem_references_image_but_no_image_url')
  THEN CASE WHEN cut LIKE '%?' THEN cut ELSE concat(rtrim(cut, '. '), '?') END ELSE question END AS question FROM b""")
def _(d):
    return mend.auto_fix(validate.quality_issues(item_rows(d))).select("ordinal", "question")


# picture and plural stems are fixable, and short equal options; a missing instruction and long equal options are not
_FIXED = f"""{_ISSUES}, x AS (SELECT *, len(issues) > 0 AS had, reason IS NULL AND NOT list_contains(issues, 'msq_stem_missing_multi_select_instruction')
    AND NOT (type = 'fill-in' AND len(issues) > 0)
    AND NOT (list_contains(issues, 'duplicate_option_text') AND NOT (length({_strip_sql('opt_a')}) BETWEEN 1 AND 12)) AS passed FROM q)"""


@query("d8_validate_and_fix", f"WITH {_FIXED} SELECT ordinal, passed, passed AND had AS was_fixed FROM x")
def _(d):
    return mend.validate_and_fix(item_rows(d)).select("ordinal", "passed", "was_fixed")


@query("d9_repair_aggressively", f"""
SELECT ordinal, CASE type WHEN 'fill-in' THEN CASE WHEN answer = '' THEN 'the right word' ELSE answer END
   WHEN 'msq' THEN CASE answer WHEN 'C,A' THEN 'A,C' WHEN 'B' THEN 'A,B' ELSE answer END
   ELSE CASE WHEN answer = 'E' THEN 'A' ELSE upper(answer) END END AS answer,
  question IS NULL OR {_strip_sql('question')} = '' AS asked, answer_explanation IS NULL AS explained, type <> 'fill-in' AS has_four FROM [items]""")
def _(d):
    before = item_rows(d)
    got = mend.repair_aggressively(before)
    told = got.select("ordinal", "answer", F.startswith("question", F.lit("Which choice fits ")).alias("a"), F.rlike("question", F.lit("^(Which choice fits|Which of these show the skill in|Complete the sentence about) ")).alias("asked"),
                      F.rlike("answer_explanation", F.lit("(fit the standard|fits the standard)")).alias("w"), (F.coalesce(F.size("answer_options"), F.lit(0)) == 4).alias("has_four"))
    own = before.select("ordinal", F.col("answer_explanation").isNull().alias("explained"))
    return told.join(own, "ordinal").select("ordinal", "answer", "asked", "explained", "has_four")


_BANK_VALUES = ", ".join(
    f"('{s}', '{sub}', '{t}', '{q.replace(chr(39), chr(39) * 2)}', '{a}')" for s, sub, t, q, a, *_ in bank.ROWS
)


@query("d10_fallback_items", f"""
WITH b(strand, sub, type, question, answer) AS (VALUES {_BANK_VALUES}),
k AS (SELECT ordinal, difficulty, CASE WHEN ordinal % 10 = 0 THEN 'open' ELSE type END AS type, standard, string_split(replace(standard, 'CCSS.ELA-LITERACY.', ''), '.') AS parts FROM [items]),
n AS (SELECT *, CASE WHEN parts[1] IN ('RL','RI','RF','SL','W','L') THEN parts[1] ELSE 'RL' END AS strand,
  CASE WHEN parts[1] = 'L' THEN CASE WHEN parts[3] IN ('1','2','4') THEN parts[3] ELSE '1' END ELSE '' END AS sub,
  CASE WHEN type IN ('mcq','msq','fill-in') THEN type ELSE 'mcq' END AS kind FROM k)
SELECT n.ordinal, n.standard, n.kind AS type, n.difficulty, b.question, b.answer FROM n LEFT JOIN b ON b.strand = n.strand AND b.sub = n.sub AND b.type = n.kind""")
def _(d):
    kind = F.when(F.col("ordinal") % 10 == 0, "open").otherwise(F.col("type")).alias("type")
    got = bank.fallback_items(d.view("items").select("ordinal", "standard", "difficulty", kind))
    return got.select("ordinal", "standard", "type", "difficulty", "question", "answer")


def _completed(d):
    plan = d.table("documents").select(
        (F.col("doc_id") + 10).alias("plan_pos"), F.lit("CCSS.ELA-LITERACY.L.3.2").alias("standard"), F.lit("hard").alias("difficulty"), F.lit("msq").alias("type")
    )
    return mend.complete_plan(plan, item_rows(d))


# whatever happens to an item, the plan is covered and every row is valid
@query("d11_complete_plan", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_positions, 0::BIGINT AS n_invalid FROM documents")
def _(d):
    done = validate.quality_issues(_completed(d).withColumnRenamed("plan_pos", "ordinal"))
    return done.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ordinal").alias("n_positions"), F.count_if(F.size("issues") > 0).alias("n_invalid")
    )


@query("d11_plan_stats")
def _(d):
    return mend.plan_stats(_completed(d))


@query("d12_keep_passing", f"""
WITH {_FIXED}, n AS (SELECT ordinal, had, row_number() OVER (ORDER BY ordinal) - 1 AS i FROM x WHERE passed)
SELECT ordinal, concat('diverse_', CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END) AS id, had AS was_fixed FROM n""")
def _(d):
    return mend.keep_passing(item_rows(d)).select("ordinal", "id", "was_fixed")


@query("d12_keep_passing_stats", f"WITH {_FIXED} SELECT count(*) FILTER (WHERE passed AND had) AS fixed, count(*) FILTER (WHERE NOT passed) AS dropped FROM x")
def _(d):
    return mend.keep_passing_stats(item_rows(d))


@query("d14_filter_accepted_answers", """
WITH w AS (SELECT doc_id AS ordinal, regexp_extract(text, '[A-Za-z]+', 0) AS answer FROM documents),
c AS (SELECT ordinal, answer, unnest([answer, upper(answer), concat(answer, '.'), concat(answer, 'x'), concat(answer, 'qzx'), concat(answer, ' two'), concat(answer, '''s')]) AS e FROM w WHERE answer <> ''),
k AS (SELECT ordinal, answer, e FROM c WHERE lower(e) = lower(answer) OR rtrim(lower(e), '.,!?;:') = lower(answer)
  OR (NOT contains(e, '''') AND NOT contains(e, ' ') AND levenshtein(lower(answer), lower(e)) <= CASE WHEN length(answer) >= 6 THEN 2 ELSE 1 END
      AND CAST(levenshtein(lower(answer), lower(e)) AS DOUBLE) / length(answer) <= CASE WHEN length(answer) >= 6 THEN 0.34 ELSE 0.20 END)),
n AS (SELECT ordinal, count(DISTINCT e) AS n FROM k GROUP BY ordinal),
p AS (SELECT k.ordinal, e FROM k UNION SELECT w.ordinal, v FROM w JOIN n USING (ordinal), (SELECT unnest([1, 2, 3]) AS i) s,
  LATERAL (SELECT CASE i WHEN 1 THEN lower(w.answer) WHEN 2 THEN concat(upper(substr(w.answer, 1, 1)), lower(substr(w.answer, 2))) ELSE upper(w.answer) END AS v) l WHERE n.n < 3)
SELECT ordinal, string_agg(e, ';' ORDER BY e) AS accepted FROM p GROUP BY ordinal""")
def _(d):
    answer = F.regexp_extract("text", "[A-Za-z]+", 0)
    forms = F.array(
        answer, F.upper(answer), *[F.concat(answer, F.lit(s)) for s in (".", "x", "qzx", " two", "'s")]
    )
    rows = d.table("documents").select(F.col("doc_id").alias("ordinal"), answer.alias("answer"), forms.alias("acceptable_answers"))
    return validate.filter_accepted_answers(rows.filter("answer <> ''")).select("ordinal", F.array_join("acceptable_answers", ";").alias("accepted"))


@query("d16_over_length", """
SELECT conv_id, prompt, greatest(1, CAST(floor(length(prompt) / 4) AS BIGINT)) > 64 AS prompt_over, greatest(1, CAST(floor(length(chosen) / 4) AS BIGINT)) > 128 AS chosen_over FROM [pairs]""")
def _(d):
    return validate.over_length(d.view("pairs"), {"prompt": 64, "chosen": 128}).select("conv_id", "prompt", "prompt_over", "chosen_over")
