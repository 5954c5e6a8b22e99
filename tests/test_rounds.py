"""Two rounds played with what the first one leaves behind."""

import json

import pytest

from itemspark.operators import joins, parse, rules
from itemspark.plans import rounds

STANDARD = "CCSS.ELA-LITERACY.L.3.1"
PLAN = [(0, "easy"), (1, "medium"), (2, "hard")]


def item(question, difficulty):
    options = {"A": "walks", "B": "walk", "C": "walking", "D": "walked"}
    return json.dumps({"id": "q", "type": "mcq", "question": question, "answer": "A", "answer_options": options, "answer_explanation": "Option A says walks.", "difficulty": difficulty})


def scorer_of(difficulties):
    """A scorer that is asked for items of these difficulties only."""

    def scorer(row):
        assert row["difficulty"] in difficulties
        return {"Who is good?": 0.95, "Who is weak?": 0.4, "Who is better?": 0.9}.get(row["question"], 0.5)

    return scorer


ALL = ("easy", "medium", "hard")


def plan_of(spark, rows=PLAN):
    return spark.createDataFrame([(k, STANDARD, d, "mcq") for k, d in rows], "plan_pos long, standard string, difficulty string, type string")


def answers(spark, **questions):
    rows = [(int(k[1:]), "m", item(q, dict(PLAN)[int(k[1:])])) for k, q in questions.items()]
    return spark.createDataFrame(rows, "plan_pos long, model string, response string")


DIMS = "ordinal long, eval_pos long, dim string, score double, reasoning string, suggestion string"
THEMES = [(["distractor"], "Make wrong options plausible."), (["never said"], "Unused.")]
DIM_THEMES = {"clarity": [(["vague"], "Say who acts.")]}


def test_two_rounds(spark):
    dims = spark.createDataFrame([(1, 0, "clarity", 0.3, "The stem is vague.", None), (1, 0, "options", 0.2, "Each distractor is silly.", "Use real errors."), (0, 0, "clarity", 0.9, "vague? no", None)], DIMS)
    history = spark.createDataFrame([(r, 1, STANDARD, "medium", "mcq", 0.3) for r in (-1, 0)], "round long, ordinal long, standard string, difficulty string, type string, score double")
    first = rounds.close_round(
        plan_of(spark), answers(spark, p0="Who is good?", p1="Who is weak?", p2="Who is good?"), scorer_of(ALL), themes=THEMES, dims=dims,
        dim_themes=DIM_THEMES, history=history, round_no=1,
    )
    assert {r.ordinal: r.score for r in first["scores"].collect()} == {0: 0.95, 1: 0.4, 2: 0.95}
    told = first["rules"].collect()
    by_scope = {s: [r.rule for r in sorted(told, key=lambda r: r.pos) if r.scope == s] for s in ("global", "standard", "standard_difficulty")}
    assert by_scope["global"] == ["Say who acts."] or by_scope["global"] == ["Make wrong options plausible.", "Say who acts."]
    assert by_scope["standard"] == ["Use real errors."]
    assert len(by_scope["standard_difficulty"]) == 2 and "the last 3 items" in by_scope["standard_difficulty"][0]
    assert [(r.difficulty, r.streak, r.bad_question) for r in first["negatives"].collect()] == [("medium", 3, "Who is weak?")]

    # the second round redoes the failed key only; the others keep item and score, and are not scored again
    second = rounds.close_round(
        plan_of(spark, PLAN[1:2]), answers(spark, p1="Who is better?"), scorer_of(("medium",)), themes=THEMES, stored_rules=first["rules"],
        best=first["best"], history=first["history"], negatives=first["negatives"], round_no=2,
    )
    assert {r.ordinal: (r.score, r.status) for r in second["scores"].collect()} == {0: (0.95, "cached"), 1: (0.9, "ok"), 2: (0.95, "cached")}
    assert {r.plan_pos: r.question for r in second["items"].collect()} == {0: "Who is good?", 1: "Who is better?", 2: "Who is good?"}
    assert second["negatives"].count() == 0  # the key passes now
    assert [(r["round"], r.pass_rate, r.improved) for r in second["progress"].orderBy("round").collect()] == [(-1, 0.0, True), (0, 0.0, False), (1, 66.7, True), (2, 100.0, True)]
    assert second["failed"].count() == 0


def test_a_key_that_keeps_failing_has_one_warning(spark):
    history = [(r, 1, STANDARD, "medium", "mcq", 0.3) for r in range(3)]
    state = {"history": spark.createDataFrame(history, "round long, ordinal long, standard string, difficulty string, type string, score double"), "negatives": None, "rules": None}
    for round_no in (3, 4):
        state = rounds.close_round(
            plan_of(spark), answers(spark, p0="Who is good?", p1="Who is weak?", p2="Who is good?"), scorer_of(ALL), stored_rules=state["rules"],
            history=state["history"], negatives=state["negatives"], round_no=round_no,
        )
    warnings = [r.rule for r in state["rules"].collect()]
    assert len(warnings) == 1 and f"the last {5} items" in warnings[0]
    assert [(r.streak, r.bad_question) for r in state["negatives"].collect()] == [(5, "Who is weak?")]


# ---- no limit unless the caller states one ----------------------------------
def test_rules_are_merged_whole(spark):
    rows = [("global", None, None, None, k, f"rule {k}") for k in range(40)] + [("standard", "S", None, None, k, f"own {k}") for k in range(20)]
    new = spark.createDataFrame([("global", None, None, None, 0, "newest"), ("standard", "S", None, None, 0, "own new")], rounds._RULES)
    merged = rules.merge_rules(spark.createDataFrame(rows, rounds._RULES), new).groupBy("scope").count().collect()
    assert {r["scope"]: r["count"] for r in merged} == {"global": 41, "standard": 21}
    capped = rules.merge_rules(spark.createDataFrame(rows, rounds._RULES), new, global_cap=10, key_cap=3).collect()
    assert [r.rule for r in sorted(capped, key=lambda r: r.pos) if r.scope == "global"] == [f"rule {k}" for k in range(31, 40)] + ["newest"]


def test_whole_responses_are_kept(spark):
    long = "no json " * 2000
    df = spark.createDataFrame([(1, long, "mcq")], "ordinal long, response string, expected_type string")
    assert parse.failure_table(parse.parse_responses(df)).collect()[0].raw_preview == long


@pytest.mark.parametrize("partial", [True, False])
def test_partial_runs_are_the_callers_choice(spark, partial):
    best = spark.createDataFrame([(0, "S", "easy", "mcq", 0.9), (1, "S", "hard", "mcq", 0.8)], "ordinal long, standard string, difficulty string, type string, score double")
    new = spark.createDataFrame([(k, "S", "hard", "mcq", None) for k in range(5, 9)], best.schema)  # more rows than the best run
    got = joins.merge_partial_run(best, new, partial=partial).collect()
    assert sorted(r.ordinal for r in got) == ([0, 5, 6, 7, 8] if partial else [5, 6, 7, 8])
    assert {r.ordinal: r.to_score for r in got} == {r.ordinal: r.ordinal >= 5 for r in got}
