"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from itemspark.llm import quality

ORACLES: dict[str, str] = {}

#: a text's words in SQL
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STRIP = r"regexp_replace({0}, '[\x20\x09-\x0D]', '', 'g')"


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


ORACLES["op8_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT doc_id, line, {_STRIP.format("line")} <> '' AS full_line,
         length(line) - length(replace(line, ' ', '')) + 1 AS n,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         upper(line) = line AND lower(line) <> line AS shouting,
         length(regexp_replace(line, '[^{quality.SEPARATORS}]', '', 'g')) AS separators,
         right(rtrim(line, ' '), 1) IN ({_quoted(quality.SENTENCE_END)}) OR regexp_matches(line, '[.!?] ') AS sentence,
         regexp_matches(lower(line), '{"|".join(quality.BOILERPLATE)}|^({"|".join(quality.BOILERPLATE_START)})') AS furniture
  FROM lines),
line_sums AS (
  SELECT doc_id,
         count(*) FILTER (full_line) - count(DISTINCT line) FILTER (full_line) AS n_dup_lines,
         coalesce(sum(length({_STRIP.format("line")})) FILTER (full_line AND NOT (
           furniture OR separators >= {quality.MAX_SEPARATORS} OR length(line) >= {quality.MIN_SENTENCE_CHARS} AND (
             symbols > {quality.MAX_SYMBOLS_PER_WORD} * n OR shouting OR NOT sentence))), 0) AS good_chars
  FROM judged GROUP BY doc_id),
grams AS (SELECT doc_id, p, md5(w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
repeated AS (SELECT doc_id, p FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length({_STRIP.format("text")}) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, good_chars
  FROM d JOIN line_sums USING (doc_id) LEFT JOIN covered c USING (doc_id)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND good_chars >= {1 - quality.MAX_LOST} * word_chars AS kept
FROM ruled
"""

ORACLES["op6_exact_top_k"] = """
WITH fit AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fit q JOIN fit c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

#: control strings as the formatter knows them, without look-ahead; each takes two more characters when escaped
_CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<\|(im_start|im_end|system|user|assistant|end|endoftext|eot_id)\|>"
_ADDED = "2 * len(regexp_extract_all({0}, '" + _CONTROL + "')) + len({0}) - len(replace({0}, chr(27), ''))"

ORACLES["op7_chat_formatting"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
sized AS (
  SELECT *, 3 + 1 + 4 + len(role) + len(text) + len(role) - len(replace(role, chr(10), ''))
            + {_ADDED.format("text")} + {_ADDED.format("role")} AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
           ((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM o
"""

ORACLES["op9_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
cell AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
held AS (
  SELECT g.lang, g.source, k.term, coalesce(cell.c, 0) AS c, k.c AS lang_c,
         CAST(sum(coalesce(cell.c, 0)) OVER (PARTITION BY g.lang, g.source) AS HUGEINT) AS n
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = k.term),
p AS (
  SELECT held.lang, source, term, c,
         1 + (1000000000::HUGEINT * (c + 2)) // (held.n + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (lang_c + 2)) // (v.n + 2 * v.v) AS q
  FROM held JOIN v ON v.lang = held.lang),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(priced.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND priced.item = b.source),
over_lang AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM over_lang))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _code_rounds(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """One pair of steps per round: nearest entry of every part, then the floor of the means."""
    dot = "list_inner_product({0}, {1})"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT x.row, x.part, x.v, arg_min(e.entry, struct_pack(d := {dot.format("x.v", "x.v")} - 2 * {dot.format("x.v", "e.v")} + {dot.format("e.v", "e.v")}, i := e.entry)) AS entry,
         min({dot.format("x.v", "x.v")} - 2 * {dot.format("x.v", "e.v")} + {dot.format("e.v", "e.v")}) AS d
  FROM x JOIN b{r} e ON e.part = x.part GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(CAST(m AS DOUBLE) ORDER BY j) AS v
       FROM (SELECT part, entry, j, floor(sum(v[j]) / count(*)) AS m
             FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS j FROM a{r}) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))""")
    return ",".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH fit AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS row
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (
  SELECT row, part, list_slice(v, len(v) // 4 * part + 1, len(v) // 4 * (part + 1)) AS v FROM fit, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM x WHERE row <= 256),
{_code_rounds()},
coded AS (
  SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY row),
books AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, j)) AS s
  FROM (SELECT part, entry, unnest(v) AS y, unnest(range(len(v))) AS j FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM fit JOIN coded USING (row), books
"""
