"""G: ranking, top-k, numbering, round tracking."""

from pyspark.sql import functions as F

from itemspark.catalog.base import query
from itemspark.operators import joins, ranks

KEYS = "standard, difficulty, type"


@query("g1_top_k_per_key", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY score DESC, ordinal) AS rank FROM [eval_rows] WHERE score >= 0.85)
SELECT ordinal, {KEYS}, score, rank FROM r WHERE rank <= 2""")
def _(d):
    got = ranks.top_k_per_key(d.view("eval_rows"), k=2)
    return got.select("ordinal", "standard", "difficulty", "type", "score", "rank")


@query("g2_select_diverse", """
WITH c AS (SELECT min(ordinal) AS ordinal, standard, difficulty, type, round(score, 3) AS score FROM [eval_rows] WHERE score IS NOT NULL
           GROUP BY standard, difficulty, type, round(score, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY standard, difficulty ORDER BY score DESC, ordinal) AS rn FROM c)
SELECT ordinal, standard, difficulty, type, score FROM r ORDER BY rn > 1, score DESC, ordinal LIMIT 150""")
def _(d):
    rows = d.view("eval_rows").filter("score is not null").select(
        "ordinal", "standard", "difficulty", "type", F.round("score", 3).alias("score")
    )
    return ranks.select_diverse(rows, 150)


@query("g3_diverse_plan", """
WITH p AS (SELECT DISTINCT standard, difficulty FROM [eval_rows] WHERE standard <> 'unknown'),
r AS (SELECT *, CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS lv,
  row_number() OVER (PARTITION BY difficulty ORDER BY CAST(concat('0x', substr(md5(concat('42|', standard, '|', difficulty)), 1, 15)) AS BIGINT), standard) AS turn FROM p)
SELECT standard, difficulty FROM r ORDER BY turn, lv LIMIT 50""")
def _(d):
    return ranks.diverse_plan(d.view("eval_rows"), 50)


@query("g4_first_passing_candidate", """
WITH f AS (SELECT standard, difficulty, min(CASE WHEN score >= 0.95 THEN ordinal END) AS winner, count(*) AS n_candidates
           FROM [eval_rows] GROUP BY standard, difficulty)
SELECT f.standard, f.difficulty, f.n_candidates, count(*) FILTER (WHERE f.winner IS NULL OR e.ordinal <= f.winner) AS evaluated,
  count(*) FILTER (WHERE e.ordinal > f.winner) AS saved, f.winner, max(CASE WHEN e.ordinal = f.winner THEN e.score END) AS winner_score
FROM f JOIN [eval_rows] e ON e.standard = f.standard AND e.difficulty = f.difficulty GROUP BY ALL""")
def _(d):
    return ranks.first_passing_candidate(d.view("eval_rows"), passing=0.95)


_FAILED = "f AS (SELECT DISTINCT standard, difficulty FROM [eval_rows] WHERE score IS NULL OR score < 0.85)"


@query("g5_batch_high_scorers", f"""
WITH {_FAILED}, r AS (SELECT e.*, row_number() OVER (PARTITION BY e.standard, e.difficulty ORDER BY score DESC, ordinal) AS rn
  FROM [eval_rows] e SEMI JOIN f ON e.standard = f.standard AND e.difficulty = f.difficulty WHERE score >= 0.85)
SELECT ordinal, standard, difficulty, type, score FROM r WHERE rn = 1""")
def _(d):
    rows = d.view("eval_rows").select("ordinal", "standard", "difficulty", "type", "score")
    return ranks.batch_high_scorers(rows, joins.failed_keys(rows))


@query("g5_best_fallback", f"""
WITH {_FAILED}, r AS (SELECT e.ordinal, e.standard, e.difficulty, coalesce(score, 0) AS score,
  row_number() OVER (PARTITION BY e.standard, e.difficulty ORDER BY coalesce(score, 0) DESC, ordinal) AS rn
  FROM [eval_rows] e SEMI JOIN f ON e.standard = f.standard AND e.difficulty = f.difficulty)
SELECT ordinal, standard, difficulty, score FROM r WHERE rn = 1 AND score >= 0.85""")
def _(d):
    rows = d.view("eval_rows").select("ordinal", "standard", "difficulty", "score")
    return ranks.best_fallback(rows, joins.failed_keys(rows))


@query("g6_progress_track", """
WITH a AS (SELECT model, grade, round, pass_rate, row_number() OVER w AS i, max(pass_rate) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  max(pass_rate) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_pass_rate, max(round) OVER (PARTITION BY model, grade) AS last_round
  FROM [rounds] WHERE pass_rate IS NOT NULL WINDOW w AS (PARTITION BY model, grade ORDER BY round)),
b AS (SELECT *, pass_rate > coalesce(prev, -1) AS improved FROM a),
c AS (SELECT *, max(CASE WHEN improved THEN round END) OVER (PARTITION BY model, grade ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_round,
  i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY model, grade ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since_best FROM b),
e AS (SELECT *, coalesce(min(CASE WHEN pass_rate >= 92 OR (since_best >= 4 AND round < last_round) THEN round END) OVER (PARTITION BY model, grade), last_round) AS end_round FROM c)
SELECT model, grade, round, pass_rate, improved, best_pass_rate, best_round, since_best, pass_rate >= 92 AS target_met, end_round FROM e WHERE round <= end_round""")
def _(d):
    return ranks.progress_track(d.view("rounds"), patience=4, target=92)


# a plain loop in SQL: each round looks at the state the previous one left
@query("g7_cycle_track", """
WITH RECURSIVE s AS (SELECT model, grade, round, pass_rate, row_number() OVER (PARTITION BY model, grade ORDER BY round) AS i,
  pass_rate >= 90 AS all_passed FROM [rounds] WHERE n_valid > 0),
t AS (SELECT model, grade, round, pass_rate, i, all_passed, CAST(1 AS BIGINT) AS cycle, CAST(1 AS BIGINT) AS inner_round FROM s WHERE i = 1
  UNION ALL SELECT s.model, s.grade, s.round, s.pass_rate, s.i, s.all_passed,
    CASE WHEN t.all_passed OR t.inner_round = 4 THEN t.cycle + 1 ELSE t.cycle END,
    CASE WHEN t.all_passed OR t.inner_round = 4 THEN 1 ELSE t.inner_round + 1 END
  FROM t JOIN s ON s.model = t.model AND s.grade = t.grade AND s.i = t.i + 1)
SELECT model, grade, round, pass_rate, cycle, inner_round, all_passed FROM t""")
def _(d):
    rounds = d.view("rounds").filter("n_valid > 0").withColumn("n_fail", F.when(F.col("pass_rate") >= 90, 0).otherwise(1))
    return ranks.cycle_track(rounds, max_inner=4)


@query("g8_failing_streaks", f"""
WITH s AS (SELECT {KEYS}, ordinal, score FROM [eval_rows] WHERE score IS NOT NULL),
p AS (SELECT {KEYS}, max(ordinal) AS lp FROM s WHERE score >= 0.95 GROUP BY ALL),
t AS (SELECT s.*, row_number() OVER (PARTITION BY s.standard, s.difficulty, s.type ORDER BY s.ordinal DESC) AS back FROM s LEFT JOIN p USING ({KEYS}) WHERE lp IS NULL OR ordinal > lp)
SELECT {KEYS}, count(*) AS streak, string_agg(CASE WHEN back <= 3 THEN CAST(round(score, 2) AS VARCHAR) END, ',' ORDER BY ordinal) AS last_scores
FROM t GROUP BY ALL HAVING count(*) >= 3""")
def _(d):
    got = ranks.failing_streaks(d.view("eval_rows"), passing=0.95)
    return got.withColumn("last_scores", F.array_join(F.transform("last_scores", lambda s: s.cast("string")), ","))


@query("g9_renumber", """
WITH n AS (SELECT ordinal, row_number() OVER (ORDER BY standard, ordinal DESC) - 1 AS i FROM [items])
SELECT ordinal, concat('diverse_', CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END) AS id FROM n""")
def _(d):
    return ranks.renumber(d.view("items").select("ordinal", "standard"), ["standard", "-ordinal"]).select("ordinal", "id")


_RUNS = "r AS (SELECT model, grade, concat('results_', lpad(CAST(round AS VARCHAR), 2, '0'), '.json') AS file, pass_rate FROM [rounds])"
_BEST = "b AS (SELECT model, grade, file, coalesce(pass_rate, -1) AS pass_rate, row_number() OVER (PARTITION BY model, grade ORDER BY coalesce(pass_rate, -1) DESC, file) AS rn FROM r)"


def _runs(d):
    file = F.concat(F.lit("results_"), F.lpad(F.col("round").cast("string"), 2, "0"), F.lit(".json"))
    return d.view("rounds").select("model", "grade", file.alias("file"), "pass_rate")


@query("g10_best_run_per_model_grade", f"WITH {_RUNS}, {_BEST} SELECT model, grade, file, pass_rate FROM b WHERE rn = 1")
def _(d):
    return ranks.best_run_per_model_grade(_runs(d))


@query("g11_rate_limit_alerts", """
WITH c AS (SELECT event_id, model, ts, count(*) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL 1800 SECONDS PRECEDING AND CURRENT ROW) AS n_recent
           FROM [failure_log])
SELECT event_id, model, ts, n_recent, ts + INTERVAL 30 SECONDS AS cooldown_until FROM c WHERE n_recent >= 3""")
def _(d):
    rows = d.view("failure_log").select("event_id", "model", "ts")
    return ranks.rate_limit_alerts(rows, ["model"], window_s=1800)


@query("g11_cooldown_alerts", """
WITH RECURSIVE c AS (SELECT event_id, model, ts, count(*) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL 1800 SECONDS PRECEDING AND CURRENT ROW) AS n_recent
           FROM [failure_log]),
a AS (SELECT model, ts, min(event_id) AS event_id, min(n_recent) AS n_recent FROM c WHERE n_recent >= 3 GROUP BY model, ts),
chain AS (SELECT model, min(ts) AS ts FROM a GROUP BY model
  UNION ALL SELECT n.model, (SELECT min(ts) FROM a WHERE a.model = n.model AND a.ts >= n.ts + INTERVAL 600 SECONDS) FROM chain n WHERE n.ts IS NOT NULL)
SELECT event_id, model, ts, n_recent, ts + INTERVAL 600 SECONDS AS cooldown_until FROM a SEMI JOIN chain USING (model, ts)""")
def _(d):
    rows = d.view("failure_log").select("event_id", "model", "ts")
    return ranks.after_cooldown(ranks.rate_limit_alerts(rows, ["model"], window_s=1800, cooldown_s=600), ["model"], cooldown_s=600)


@query("g12_recent_n", "SELECT event_id, ts, model, reason FROM [failure_log] ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(d):
    return ranks.recent_n(d.view("failure_log"), 10).select("event_id", "ts", "model", "reason")


@query("g13_dedupe_standards", """
SELECT standard_id, min(pos) AS pos, arg_min(grade, pos) AS grade, arg_min(subject_abbr, pos) AS subject_abbr,
  arg_min(standard_description, pos) AS standard_description, arg_min(objective, pos) FILTER (WHERE objective IS NOT NULL) AS objective,
  arg_min(misconception, pos) FILTER (WHERE misconception IS NOT NULL) AS misconception
FROM [curriculum_blocks] GROUP BY standard_id""")
def _(d):
    return ranks.dedupe_standards(d.view("curriculum_blocks"))


@query("g14_recover_best", f"""
WITH {_RUNS}, {_BEST} SELECT model, grade, file, pass_rate, replace(CAST(round(pass_rate, 1) AS VARCHAR), '.', '_') AS rate_label FROM b WHERE rn = 1""")
def _(d):
    return ranks.recover_best(_runs(d))
