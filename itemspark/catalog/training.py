"""B, F6-F7, I, K: columns, corpus profiles, training sets, scoring."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.catalog.sourcing import chats, pairs
from itemspark.catalog.validation import _REJECT, _WS, item_rows
from itemspark.functions import chat, classes, curriculum, text
from itemspark.functions import fixed_values as V
from itemspark.operators import aggs, profile, score, training, validate
from itemspark.skew import settle

_TOK = "greatest(1, CAST(floor(length({c}) / 4) AS BIGINT))"
_TURN = "concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10))"


@query("b1_chat_text", f"""
SELECT conv_id, string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN {_TURN} END, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def _(d):
    return chats(d).select("conv_id", chat.chat_text(F.col("messages")).alias("text"))


def _strip_sql(col):
    return f"regexp_replace({col}, '^{_WS}|{_WS}$', '', 'g')"


@query("b2_last_messages", f"""
SELECT conv_id, {_strip_sql("arg_max(text, turn) FILTER (WHERE role = 'user')")} AS last_user, {_strip_sql("arg_max(text, turn) FILTER (WHERE role = 'assistant')")} AS last_assistant
FROM conversations GROUP BY conv_id""")
def _(d):
    m = F.col("messages")
    return chats(d).select("conv_id", chat.last_content(m, "user").alias("last_user"), chat.last_content(m, "assistant").alias("last_assistant"))


@query("b3_prompt_user", """
WITH g AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS l, arg_min(text, turn) FILTER (WHERE role = 'user') AS f,
  string_agg(text, ' ' ORDER BY turn) AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(nullif(l, ''), a) AS last_user, coalesce(nullif(f, ''), a) AS first_user FROM g""")
def _(d):
    m = F.col("messages")
    return chats(d).select("conv_id", chat.prompt_user(m, "last", None).alias("last_user"), chat.prompt_user(m, "first", None).alias("first_user"))


@query("b4_standard_in_text", """
WITH t AS (SELECT ordinal, CASE ordinal % 3 WHEN 0 THEN concat(coalesce(question, ''), ' for ', standard, '.') WHEN 1 THEN concat('standard id: ', standard, ' ', coalesce(question, ''))
  ELSE concat('STANDARD ID:  x', CAST(ordinal AS VARCHAR), ' ', coalesce(question, '')) END AS t FROM [items])
SELECT ordinal, coalesce(nullif(regexp_extract(t, '(CCSS\\.ELA-LITERACY\\.[A-Z0-9.-]+)', 1), ''), nullif(regexp_extract(t, '(?i)Standard ID:\\s*(\\S+)', 1), '')) AS standard FROM t""")
def _(d):
    q = F.coalesce("question", F.lit(""))
    t = (
        F.when(F.col("ordinal") % 3 == 0, F.concat(q, F.lit(" for "), "standard", F.lit(".")))
        .when(F.col("ordinal") % 3 == 1, F.concat(F.lit("standard id: "), "standard", F.lit(" "), q))
        .otherwise(F.concat(F.lit("STANDARD ID:  x"), F.col("ordinal").cast("string"), F.lit(" "), q))
    )
    return d.view("items").select("ordinal", chat.standard_in_text(t).alias("standard"))


@query("b5_b6_text_flags", f"""
WITH t AS (SELECT conv_id, turn, concat(CASE turn % 3 WHEN 0 THEN '<think>' WHEN 1 THEN '<think></think>' ELSE '' END, text) AS t FROM conversations)
SELECT conv_id, turn, contains(t, '<think>') AS opened, contains(t, '<think>') AND contains(t, '</think>') AS closed, {_TOK.format(c='t')} AS n_tokens FROM t""")
def _(d):
    head = F.when(F.col("turn") % 3 == 0, "<think>").when(F.col("turn") % 3 == 1, "<think></think>").otherwise("")
    rows = d.table("conversations").select("conv_id", "turn", F.concat(head, "text").alias("t"))
    return rows.select("conv_id", "turn", chat.has_think(F.col("t")).alias("opened"), chat.has_think(F.col("t"), True).alias("closed"), text.est_tokens(F.col("t")).alias("n_tokens"))


@query("b7_norm_text_snippet", f"""
WITH n AS (SELECT doc_id, {_strip_sql(f"regexp_replace(concat(chr(160), text, chr(8195), ' end'), '{_WS}', ' ', 'g')")} AS norm FROM documents)
SELECT doc_id, norm, CASE WHEN length(norm) > 200 THEN concat(substr(norm, 1, 197), '...') ELSE norm END AS snippet FROM n""")
def _(d):
    t = F.concat(F.lit(" "), "text", F.lit("  end"))
    return d.table("documents").select("doc_id", text.norm_text(t).alias("norm"), text.snippet(t, 200).alias("snippet"))


@query("b8_b10_standard_parts", """
SELECT ordinal, replace(standard, 'CCSS.ELA-LITERACY.', '') AS short, CASE WHEN contains(standard, '.RL.') THEN 'RL' WHEN contains(standard, '.RI.') THEN 'RI'
  WHEN contains(standard, '.RF.') THEN 'RF' WHEN contains(standard, '.SL.') THEN 'SL' WHEN contains(standard, '.W.') THEN 'W' WHEN contains(standard, '.L.') THEN 'L' END AS strand FROM [eval_rows]""")
def _(d):
    s = F.col("standard")
    return d.view("eval_rows").select("ordinal", text.short_standard(s).alias("short"), text.strand(s).alias("strand"))


@query("b9_grade", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AP' WHEN 1 THEN 'K' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN 'HS' ELSE 'unknown' END AS grade,
  CASE WHEN p_partkey % 6 IN (2, 3) THEN CASE p_size WHEN 9 THEN '10' WHEN 12 THEN '11' ELSE CAST(p_size AS VARCHAR) END
       ELSE CASE p_partkey % 6 WHEN 0 THEN 'AP' WHEN 1 THEN 'K' WHEN 4 THEN 'HS' ELSE 'unknown' END END AS stored FROM part""")
def _(d):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    course = (
        F.when(kind == 0, F.concat(F.lit("AP "), "p_name")).when(kind == 1, F.concat(F.lit("Kindergarten "), "p_name"))
        .when(kind == 2, F.concat(size, F.lit("th Grade ELA"))).when(kind == 3, F.concat(F.lit("ELA Grade "), size))
        .when(kind == 4, F.lit("High School ELA")).otherwise("Reading")
    )
    g = curriculum.grade_of_course(course)
    return d.table("part").select("p_partkey", g.alias("grade"), curriculum.stored_grade(g).alias("stored"))


@query("b12_failure_class", """
SELECT event_id, CASE WHEN contains(reason, '429') OR contains(lower(reason), 'quota') OR contains(lower(reason), 'rate') THEN 'rate_limit' WHEN contains(reason, 'timed out') THEN 'timeout'
  WHEN contains(reason, '503') THEN 'server' WHEN contains(reason, 'content_filter') THEN 'content_filter' ELSE 'unknown' END AS class, reason <> 'content_filter' AS retry,
  contains(reason, '503') OR contains(reason, 'timeout') AS server_error FROM [failure_log]""")
def _(d):
    r = F.col("reason")
    return d.view("failure_log").select("event_id", classes.failure_class(r).alias("class"), classes.retryable(r).alias("retry"), classes.is_server_error(r).alias("server_error"))


@query("b13_low_score_causes", """
WITH t AS (SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'The distractors are implausible. ' WHEN 1 THEN 'Explanation lacks detail. ' ELSE '' END, text) AS r FROM documents),
l AS (SELECT doc_id, r, lower(r) AS x FROM t),
c AS (SELECT doc_id, r, concat_ws('|', CASE WHEN regexp_matches(x, 'distract|option|implaus|answer choice') THEN 'options' END, CASE WHEN regexp_matches(x, 'explanation|rationale') THEN 'explanation' END,
  CASE WHEN regexp_matches(x, 'alignment|standard|curriculum|does not align') THEN 'alignment' END, CASE WHEN regexp_matches(x, 'unclear|confus|ambig|grammar|ungrammat') THEN 'wording' END,
  CASE WHEN regexp_matches(x, 'mislabel|difficulty level|too easy|too hard') THEN 'difficulty' END, CASE WHEN regexp_matches(x, 'missing|lack|absent|do not exist') THEN 'missing' END) AS k FROM l)
SELECT doc_id, CASE WHEN k <> '' THEN k ELSE r END AS causes FROM c""")
def _(d):
    head = F.when(F.col("doc_id") % 3 == 0, "The distractors are implausible. ").when(F.col("doc_id") % 3 == 1, "Explanation lacks detail. ").otherwise("")
    return d.table("documents").select("doc_id", F.array_join(classes.low_score_causes(F.concat(head, "text")), "|").alias("causes"))


@query("b13_score_remarks", """
WITH l AS (SELECT event_id, reason, lower(reason) AS x FROM [failure_log]),
c AS (SELECT event_id, reason, x, concat_ws('|', CASE WHEN regexp_matches(x, 'distract|option|implaus|answer choice') THEN 'options' END, CASE WHEN regexp_matches(x, 'explanation|rationale') THEN 'explanation' END,
  CASE WHEN regexp_matches(x, 'alignment|standard|curriculum|does not align') THEN 'alignment' END, CASE WHEN regexp_matches(x, 'unclear|confus|ambig|grammar|ungrammat') THEN 'wording' END,
  CASE WHEN regexp_matches(x, 'mislabel|difficulty level|too easy|too hard') THEN 'difficulty' END, CASE WHEN regexp_matches(x, 'missing|lack|absent|do not exist') THEN 'missing' END) AS k FROM l)
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN CASE WHEN k <> '' THEN k ELSE reason END
  WHEN contains(x, 'timeout') OR contains(x, 'timed out') THEN 'timeout' WHEN contains(reason, '429') THEN 'rate_limit'
  WHEN regexp_matches(reason, '500|502|503|504') THEN 'server_error' ELSE reason END AS remark FROM c""")
def _(d):
    status = F.when(F.col("event_id") % 2 == 0, "error").otherwise("ok")
    return d.view("failure_log").select("event_id", F.array_join(classes.score_remarks(status, F.col("reason"), F.col("reason")), "|").alias("remark"))


@query("b15_money", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' WHEN 2 THEN 'USD' END AS currency,
  CASE WHEN o_orderkey % 4 < 2 THEN CAST(round(o_totalprice, 2) AS DECIMAL(18,6)) END AS amount FROM orders""")
def _(d):
    price = F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    kind = F.col("o_orderkey") % 4
    t = F.when(kind == 0, F.concat(F.lit("$"), price)).when(kind == 1, F.concat(F.lit("¥"), price)).when(kind == 2, "$n/a").otherwise(price)
    return d.table("orders").select("o_orderkey", classes.currency(t).alias("currency"), classes.amount(t).alias("amount"))


@query("f6_profile_messages", f"""
WITH s AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS lr, arg_max(text, turn) AS lt, sum({_TOK.format(c='text')}) AS tok FROM conversations GROUP BY conv_id)
SELECT count(*) AS total, count(*) FILTER (WHERE lr <> 'assistant') AS no_assistant, count(*) FILTER (WHERE lr = 'assistant' AND {_strip_sql('lt')} = '') AS empty_assistant,
  count(*) FILTER (WHERE lr = 'assistant' AND tok > 2048) AS over_sft_max, count(*) FILTER (WHERE lr = 'assistant' AND {_strip_sql('lt')} <> '') AS no_json FROM s""")
def _(d):
    return profile.profile_messages(chats(d)).select("total", "no_assistant", "empty_assistant", "over_sft_max", "no_json")


def item_chats(d):
    """Samples whose reply is an item as plain JSON."""
    body = F.to_json(F.struct("id", "type", "question", "answer", "answer_options", "acceptable_answers", "difficulty", "answer_explanation"))
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    ask = F.concat(F.lit("Write an item. Standard ID: "), "standard")
    messages = F.array(turn("system", F.lit("You write items.")), turn("user", ask), turn("assistant", body))
    return settle(item_rows(d).select("ordinal", messages.alias("messages")))


@query("f6_profile_items", """
SELECT count(*) AS total, count(*) FILTER (WHERE question IS NULL OR answer_explanation IS NULL OR type = 'fill-in') AS incomplete,
  count(*) FILTER (WHERE type <> 'fill-in' AND opt_d IS NULL) AS bad_options, count(*) FILTER (WHERE answer <> '' AND upper(answer) NOT IN ('A', 'B', 'C', 'D')) AS bad_answer FROM [items]""")
def _(d):
    return profile.profile_messages(item_chats(d)).select("total", "incomplete", "bad_options", "bad_answer")


@query("f6_missing_fields", """
SELECT 'question' AS field, count(*) AS n FROM [items] WHERE question IS NULL UNION ALL SELECT 'answer_explanation', count(*) FROM [items] WHERE answer_explanation IS NULL
UNION ALL SELECT 'answer_options', count(*) FROM [items] WHERE type = 'fill-in'""")
def _(d):
    return profile.missing_fields(item_chats(d))


@query("f7_profile_pairs", f"""
SELECT count(*) AS valid, count(*) FILTER (WHERE {_TOK.format(c='prompt')} > 512) AS over_prompt_max,
  count(*) FILTER (WHERE {_TOK.format(c='chosen')} > 1024 OR {_TOK.format(c='rejected')} > 1024) AS over_response_max,
  count(*) FILTER (WHERE chosen_score - rejected_score <= 0) AS score_order_wrong,
  count(*) FILTER (WHERE chosen_score - rejected_score > 0 AND chosen_score - rejected_score < 0.05) AS score_gap_small FROM [pairs] WHERE rejected IS NOT NULL""")
def _(d):
    return profile.profile_pairs(pairs(d)).select("valid", "over_prompt_max", "over_response_max", "score_order_wrong", "score_gap_small")


@query("f7_pair_lengths", f"""
WITH l AS (SELECT unnest(['prompt', 'chosen', 'rejected']) AS role, unnest([{_TOK.format(c='prompt')}, {_TOK.format(c='chosen')}, {_TOK.format(c='rejected')}]) AS n FROM [pairs] WHERE rejected IS NOT NULL),
r AS (SELECT role, n, row_number() OVER (PARTITION BY role ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY role) AS c FROM l)
SELECT role, count(*) AS n_rows, min(n) AS min_len, max(CASE WHEN i = least(CAST(floor(c * 50 / 100) AS BIGINT), c - 1) THEN n END) AS p50,
  max(CASE WHEN i = least(CAST(floor(c * 95 / 100) AS BIGINT), c - 1) THEN n END) AS p95, max(n) AS max_len, round(CAST(sum(n) AS DOUBLE) / count(*), 4) AS mean_len FROM r GROUP BY role""")
def _(d):
    return aggs.length_summary(profile.pair_lengths(pairs(d)))


@query("i1_build_sft", f"""
SELECT conv_id, 'instruction_following' AS source, string_agg({_TURN}, '' ORDER BY turn) AS text, CAST(NULL AS DOUBLE) AS quality_score, contains(arg_max(text, turn), '<think>') AS has_think_chain
FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND arg_max(role, turn) = 'assistant'
UNION ALL SELECT conv_id, 'dpo_chosen', concat('<|im_start|>user', chr(10), prompt, '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), chosen, '<|im_end|>'), coalesce(chosen_score, 0.9), contains(chosen, '<think>')
FROM [pairs] WHERE rejected IS NOT NULL""")
def _(d):
    return training.build_sft(chats(d), pairs(d), keep=["conv_id"]).select("conv_id", "source", "text", "quality_score", "has_think_chain")


@query("i2_build_dpo", """
SELECT conv_id, concat('<|im_start|>user', chr(10), prompt, '<|im_end|>', chr(10)) AS prompt, chosen, rejected, coalesce(chosen_score, 0.9) AS chosen_score, rejected_score, 'medium' AS difficulty
FROM [pairs] WHERE rejected IS NOT NULL""")
def _(d):
    return training.build_dpo(pairs(d), keep=["conv_id"])


@query("i3_example_candidates", f"""
SELECT ordinal, standard, difficulty, 1.0::DOUBLE AS score, 'messages' AS source, type FROM [items] WHERE ({_REJECT}) IS NULL""")
def _(d):
    got = training.candidates_from_chats(item_chats(d), "ordinal")
    return got.select("ordinal", "standard", "difficulty", "score", "source", "item.type")


_TOKENS = f"regexp_split_to_array({{c}}, '{_WS.replace('{', '{{').replace('}', '}}')}')"
_VOCAB = """v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM w GROUP BY token))"""


# a row is padded to the end of its bucket of 64 tokens
@query("i4_encode_sft", f"""
WITH t AS (SELECT doc_id, list_filter({_TOKENS.format(c='text')}, lambda x: x <> '') AS toks FROM documents),
w AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM t), {_VOCAB},
e AS (SELECT w.doc_id, count(*) AS n, CAST(sum(v.id * w.pos) AS BIGINT) AS s, max(v.id) AS top FROM w JOIN v USING (token) GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(n, 0) AS n_real, coalesce(s, 0) AS checksum, coalesce(s, 0) - 100 * ((64 - coalesce(n, 0) % 64) % 64) AS label_sum, coalesce(top, 0) AS top,
  (64 - coalesce(n, 0) % 64) % 64 AS n_ignored FROM t LEFT JOIN e ON e.doc_id = t.doc_id""")
def _(d):
    docs = d.table("documents").select("doc_id", "text")
    got = training.encode_sft(docs, ["doc_id"], training.build_vocabulary(docs), pad_to=64)
    labels = F.zip_with("labels", F.sequence(F.lit(1), F.size("labels")), lambda x, i: F.when(x == -100, x).otherwise(x * i))
    return got.select(
        "doc_id", _total(F.transform("attention_mask", lambda x: x.cast("long"))).alias("n_real"), _checksum("input_ids").alias("checksum"),
        _total(F.when(F.size("labels") > 0, labels).otherwise(F.col("labels"))).alias("label_sum"), F.coalesce(F.array_max("input_ids"), F.lit(0)).alias("top"),
        F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("n_ignored"),
    )


def _total(a):
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def _checksum(ids):
    return _total(F.transform(ids, lambda x, i: x * (i + 1)))


@query("i5_encode_dpo", f"""
WITH p AS (SELECT conv_id, prompt, chosen, rejected FROM [pairs] WHERE rejected IS NOT NULL),
l AS (SELECT conv_id, 'prompt' AS side, prompt AS x FROM p UNION ALL SELECT conv_id, 'chosen', chosen FROM p UNION ALL SELECT conv_id, 'rejected', rejected FROM p),
t AS (SELECT conv_id, side, list_filter({_TOKENS.format(c='x')}, lambda y: y <> '') AS toks FROM l),
w AS (SELECT conv_id, side, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM t), {_VOCAB},
e AS (SELECT conv_id, side, sum(v.id * pos) AS s, count(*) AS n FROM w JOIN v USING (token) GROUP BY ALL),
a AS (SELECT t.conv_id, t.side, CAST(coalesce(e.s, 0) AS BIGINT) AS s, coalesce(e.n, 0) AS n FROM t LEFT JOIN e ON e.conv_id = t.conv_id AND e.side = t.side)
SELECT conv_id, max(s) FILTER (side = 'prompt') AS prompt, max(s) FILTER (side = 'chosen') AS chosen, max(s) FILTER (side = 'rejected') AS rejected,
  max(n) FILTER (side = 'prompt') AS prompt_mask, max(n) FILTER (side = 'chosen') AS chosen_mask, max(n) FILTER (side = 'rejected') AS rejected_mask FROM a GROUP BY conv_id""")
def _(d):
    p = d.view("pairs").filter("rejected is not null").select("conv_id", "prompt", "chosen", "rejected")
    texts = p.select(F.explode(F.array("prompt", "chosen", "rejected")).alias("text"))
    got = training.encode_dpo(p, "conv_id", training.build_vocabulary(texts), pad_to=64)
    masks = [_total(F.transform(f"{c}_attention_mask", lambda x: x.cast("long"))).alias(f"{c}_mask") for c in ("prompt", "chosen", "rejected")]
    return got.select("conv_id", *[_checksum(f"{c}_input_ids").alias(c) for c in ("prompt", "chosen", "rejected")], *masks)


@query("i6_augment_to", """
SELECT false AS is_added, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents
UNION ALL SELECT true, CAST(ceil(count(*) / 4) AS BIGINT), 3 FROM documents""")
def _(d):
    docs = d.table("documents").select("text", "lang")
    n = docs.count()
    return training.augment_to(docs, n + -(-n // 4), {"lang": ["x", "y", "z"]}).groupBy("is_added").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("n_langs")
    )


@query("i7_split", """
SELECT doc_id, CAST(concat('0x', substr(md5(concat('42|', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) % 1000 < 900 AS is_train FROM documents""")
def _(d):
    return training.split(d.table("documents").select("doc_id"), ["doc_id"])


@query("i8_length_buckets", f"""
WITH t AS (SELECT {_TOK.format(c='text')} AS n FROM documents), b AS (SELECT CAST(floor(n / 64) AS BIGINT) AS bucket, n FROM t)
SELECT bucket, count(*) AS n_rows, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(count(*) * max(n) - sum(n) AS BIGINT) AS n_padding FROM b GROUP BY bucket""")
def _(d):
    return training.padding_report(training.length_buckets(d.table("documents").select("doc_id", "text")))


@query("k1_score_items", """
WITH c AS (SELECT ordinal, score FROM [eval_rows] WHERE ordinal % 2 = 0 AND score IS NOT NULL)
SELECT i.ordinal, CASE WHEN c.score IS NOT NULL THEN c.score ELSE (CASE WHEN question IS NOT NULL AND trim(question) <> '' THEN 1 ELSE 0 END + CASE WHEN answer <> '' THEN 1 ELSE 0 END
  + CASE WHEN answer_explanation IS NOT NULL THEN 1 ELSE 0 END) / 3 END AS score, CASE WHEN c.score IS NOT NULL THEN 'cached' ELSE 'ok' END AS status FROM [items] i LEFT JOIN c ON c.ordinal = i.ordinal""")
def _(d):
    items = d.view("items").select("ordinal", "question", "answer", "answer_explanation")
    cached = d.view("eval_rows").filter("ordinal % 2 = 0").select("ordinal", "score")
    return score.score_items(items, score.completeness_scorer(), cached).select("ordinal", "score", "status")


@query("k2_extra_rules", f"""
WITH v AS (SELECT ordinal, ({_REJECT}) AS r, length(question) AS n FROM [items]) SELECT ordinal, coalesce(r, CASE WHEN n > 2000 THEN 'stem_too_long' END) AS reject_reason FROM v""")
def _(d):
    rule = ("stem_too_long", F.length("question") > 2000)
    return validate.validate_schema(item_rows(d), extra=[rule]).select("ordinal", "reject_reason")
