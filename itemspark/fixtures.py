"""Views over the given tables in the shapes the operators work on.

One SQL text per view serves both engines: ``{table}`` placeholders become
DataFrames in Spark and table names in an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from itemspark.skew import on_all_cores

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

TEXT_TABLES = ["documents", "conversations", "pages"]

VIEWS: dict[str, str] = {}

VIEWS["eval_rows"] = """
SELECT event_id AS ordinal,
       concat('m', CAST(user_id % 4 AS STRING)) AS model,
       CAST(1 + user_id % 12 AS STRING) AS grade,
       concat('CCSS.ELA-LITERACY.',
              CASE user_id % 6 WHEN 0 THEN 'RL' WHEN 1 THEN 'RI' WHEN 2 THEN 'RF'
                               WHEN 3 THEN 'W' WHEN 4 THEN 'L' ELSE 'SL' END,
              '.', CAST(1 + user_id % 12 AS STRING), '.', CAST(1 + user_id % 9 AS STRING)) AS standard,
       CASE event_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE CAST(floor(event_id / 3) AS BIGINT) % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'msq' ELSE 'fill-in' END AS type,
       CAST(day(ts) AS INT) AS round,
       ts,
       CASE WHEN event_type = 'error' AND value < 20 THEN NULL
            ELSE 1 - least(value, 500) / 600 END AS score,
       CASE WHEN event_type = 'error' AND value < 20 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN event_type = 'error' AND value < 20
            THEN CASE event_id % 5 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'request timed out'
                                   WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'Could not save evaluation result to the DB'
                                   ELSE 'bad payload' END END AS message
FROM {events}
"""

VIEWS["eval_big"] = """
SELECT concat(l_returnflag, l_linestatus) AS model,
       concat('S.', CAST(l_partkey % 79 AS STRING)) AS standard,
       CASE l_linenumber % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE l_suppkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'msq' ELSE 'fill-in' END AS type,
       CAST(month(l_shipdate) AS INT) AS round,
       1 - l_discount * 2 AS score
FROM {lineitem}
"""

# the four options of an item are the four quarters of its text
VIEWS["items"] = """
SELECT doc_id AS ordinal,
       concat('item_', CAST(doc_id AS STRING)) AS id,
       CASE doc_id % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'msq' ELSE 'fill-in' END AS type,
       concat('CCSS.ELA-LITERACY.', CASE doc_id % 4 WHEN 0 THEN 'RL' WHEN 1 THEN 'RI' WHEN 2 THEN 'L' ELSE 'W' END,
              '.', CAST(1 + doc_id % 12 AS STRING), '.', CAST(1 + doc_id % 9 AS STRING)) AS standard,
       CASE CAST(floor(doc_id / 3) AS BIGINT) % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            WHEN doc_id % 3 = 1 AND doc_id % 5 <> 0 THEN concat('Select all that apply. ', text)
            WHEN doc_id % 3 = 2 AND doc_id % 5 <> 0 THEN concat(text, ' ______')
            WHEN doc_id % 7 = 0 THEN concat('Look at the picture. ', text)
            WHEN doc_id % 11 = 0 THEN concat('Which choices correctly complete: ', text)
            ELSE text END AS question,
       CASE WHEN doc_id % 3 = 1 THEN CASE doc_id % 4 WHEN 0 THEN 'A,C' WHEN 1 THEN 'B' WHEN 2 THEN 'A,B,D' ELSE 'C,A' END
            WHEN doc_id % 3 = 2 THEN regexp_extract(text, '[A-Za-z]+', 0)
            ELSE CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END END AS answer,
       CASE WHEN doc_id % 3 = 2 THEN NULL ELSE substr(text, 1, CAST(floor(length(text) / 4) AS INT)) END AS opt_a,
       CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 13 = 0 THEN substr(text, 1, CAST(floor(length(text) / 4) AS INT))
            ELSE substr(text, 1 + CAST(floor(length(text) / 4) AS INT), CAST(floor(length(text) / 4) AS INT)) END AS opt_b,
       CASE WHEN doc_id % 3 = 2 THEN NULL
            ELSE substr(text, 1 + 2 * CAST(floor(length(text) / 4) AS INT), CAST(floor(length(text) / 4) AS INT)) END AS opt_c,
       CASE WHEN doc_id % 3 = 2 OR doc_id % 19 = 0 THEN NULL
            ELSE substr(text, 1 + 3 * CAST(floor(length(text) / 4) AS INT)) END AS opt_d,
       CASE WHEN doc_id % 3 <> 2 THEN NULL WHEN doc_id % 8 = 0 THEN 'other'
            ELSE lower(regexp_extract(text, '[A-Za-z]+', 0)) END AS acceptable_1,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE concat('Option A is correct because ', text) END AS answer_explanation
FROM {documents}
"""

VIEWS["pairs"] = """
SELECT c.conv_id, u.text AS prompt, c.text AS chosen, r.text AS rejected,
       CASE WHEN c.conv_id % 6 = 0 THEN NULL ELSE CAST(50 + c.conv_id % 50 AS DOUBLE) / 100 END AS chosen_score,
       CAST(10 + c.conv_id % 7 AS DOUBLE) / 20 AS rejected_score
FROM (SELECT conv_id, turn, text FROM {conversations} WHERE role = 'assistant') c
JOIN (SELECT conv_id, min(turn) AS turn FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id) f
  ON c.conv_id = f.conv_id AND c.turn = f.turn
JOIN (SELECT conv_id, turn, text FROM {conversations} WHERE role = 'user') u
  ON u.conv_id = c.conv_id AND u.turn = c.turn - 1
LEFT JOIN (SELECT a.conv_id, max(a.text) AS text FROM {conversations} a WHERE a.role = 'assistant' GROUP BY a.conv_id) r
  ON r.conv_id = c.conv_id + 1
"""

VIEWS["curriculum_blocks"] = """
SELECT p.p_partkey AS pos, concat('S.', CAST(p.p_partkey % 79 AS STRING)) AS standard_id,
       CAST(1 + (p.p_partkey % 79) % 12 AS STRING) AS grade,
       CASE (p.p_partkey % 79) % 3 WHEN 0 THEN 'ELA' WHEN 1 THEN 'READ' ELSE 'MATH' END AS subject_abbr,
       p.p_name AS standard_description,
       CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE p.p_type END AS objective,
       CASE WHEN p.p_partkey % 5 < 3 THEN NULL ELSE p.p_brand END AS misconception
FROM {part} p
"""

VIEWS["token_usage"] = """
SELECT o_orderkey AS call_id, concat('m', CAST(o_custkey % 4 AS STRING)) AS model,
       CAST(month(o_orderdate) AS INT) AS round,
       CAST(floor(o_totalprice) AS BIGINT) % 9000 AS prompt_tokens,
       CAST(floor(o_totalprice) AS BIGINT) % 700 AS completion_tokens,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 9000 ELSE 0 END AS cache_hit_tokens
FROM {orders}
"""

VIEWS["failure_log"] = """
SELECT event_id, ts, concat('m', CAST(user_id % 4 AS STRING)) AS model,
       concat('S.', CAST(user_id % 79 AS STRING)) AS standard,
       CASE event_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE event_id % 7 WHEN 0 THEN 'missing fields: answer_explanation' WHEN 1 THEN 'answer_options keys must be A,B,C,D'
                         WHEN 2 THEN 'HTTP 429 rate limit' WHEN 3 THEN 'request timed out' WHEN 4 THEN 'HTTP 503'
                         WHEN 5 THEN 'content_filter' ELSE 'JSON parse failed' END AS reason,
       props AS raw_preview
FROM {events} WHERE event_type = 'error'
"""

# one row per (model, grade, round): what a round log holds
VIEWS["rounds"] = """
SELECT model, grade, round,
       CAST(count(score) AS BIGINT) AS n_valid,
       CAST(count(*) AS BIGINT) AS n_submitted,
       CAST(sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS BIGINT) AS pass_count,
       CASE WHEN count(score) = 0 THEN NULL
            ELSE round(CAST(100 * sum(CASE WHEN score >= 0.85 THEN 1 ELSE 0 END) AS DOUBLE) / count(score), 1) END AS pass_rate
FROM ([eval_rows]) e GROUP BY model, grade, round
"""

# three tables of a question store
VIEWS["generated"] = """
SELECT o_orderkey AS question_id, o_custkey AS recipe_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'mcq' WHEN 1 THEN 'msq' WHEN 2 THEN 'fill-in' ELSE 'open' END AS question_type,
       concat(chr(123), '"difficulty": "', CASE CAST(floor(o_totalprice) AS BIGINT) % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium'
              WHEN 2 THEN 'hard' ELSE 'extreme' END, '", "status": "', o_orderstatus, '"', chr(125)) AS response
FROM {orders}
"""

VIEWS["recipes"] = """
SELECT c_custkey AS recipe_id,
       CASE c_nationkey % 5 WHEN 0 THEN 'ela' WHEN 1 THEN 'language' WHEN 2 THEN 'reading' WHEN 3 THEN 'math' ELSE 'science' END AS subject,
       CAST(1 + c_custkey % 3 AS STRING) AS grade_level,
       concat(CASE WHEN c_custkey % 7 = 0 THEN 'LOCAL.' ELSE 'CCSS.ELA-LITERACY.RL.' END, CAST(c_custkey % 11 AS STRING)) AS standard,
       c_name AS standard_desc
FROM {customer}
"""

VIEWS["question_scores"] = """
SELECT l_orderkey AS question_id, 1 - l_discount * 2 AS score FROM {lineitem}
"""

# stored rules, failed items shown as counter-examples
VIEWS["rules"] = """
SELECT p_partkey AS pos,
       CASE p_partkey % 10 WHEN 0 THEN 'global' WHEN 1 THEN 'standard' WHEN 2 THEN 'standard' WHEN 3 THEN 'standard'
            ELSE 'standard_difficulty' END AS scope,
       concat('CCSS.ELA-LITERACY.', CASE p_partkey % 4 WHEN 0 THEN 'RL' WHEN 1 THEN 'RI' WHEN 2 THEN 'L' ELSE 'W' END,
              '.', CAST(1 + p_partkey % 12 AS STRING), '.', CAST(1 + p_partkey % 9 AS STRING)) AS standard,
       CASE CAST(floor(p_partkey / 3) AS BIGINT) % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE p_partkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'msq' ELSE 'fill-in' END AS type,
       p_name AS rule
FROM {part}
"""

VIEWS["negatives"] = """
SELECT standard, difficulty, type, min(ordinal) AS bad_ordinal, CAST(count(*) AS BIGINT) AS streak
FROM ([eval_rows]) n WHERE score < 0.6 GROUP BY standard, difficulty, type
"""


def _expand(text: str) -> str:
    """Replace ``[view]`` by the text of that view."""
    return re.sub(r"\[(\w+)\]", lambda m: _expand(VIEWS[m.group(1)]), text)


def view_sql(name: str) -> str:
    return _expand(VIEWS[name])


class Data:
    """The tables of one folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # long texts cost far more to work on than to move: a file of one row group must not keep them on one core
        return on_all_cores(rows) if name in TEXT_TABLES else rows

    def sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if "{%s}" % t in text}
        return self.spark.sql(text, **used)

    def view(self, name: str) -> DataFrame:
        return self.sql(view_sql(name))


def oracle(text: str) -> str:
    """Oracle SQL in which ``[view]`` stands for a fixture view.

    ``text`` is a query, or common table expressions followed by a query
    (starting with WITH).
    """
    names = list(dict.fromkeys(n for n in re.findall(r"\[(\w+)\]", text) if n in VIEWS))
    body = re.sub(r"\[(\w+)\]", lambda m: m.group(1) if m.group(1) in VIEWS else m.group(0), text).strip()
    ctes = ", ".join(f"{n} AS ({view_sql(n).strip()})" for n in names)
    for table in TABLES:
        ctes = ctes.replace("{%s}" % table, table)
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
