"""Rules from long feedback, without cuts that nobody asked for."""

from itemspark.operators import rules

SCHEMA = "ordinal long, standard string, difficulty string, type string, score double, suggestion string, reasoning string, internal_reasoning string"


def test_nothing_is_cut_by_default(spark):
    long_text = "word " * 300
    rows = [(k, "S.1", "easy", "mcq", 0.1, None, f"{long_text} theme{k}", None) for k in range(7)]
    feedback = rules.failure_feedback(spark.createDataFrame(rows, SCHEMA))
    themes = [([f"theme{k}"], f"rule {k}") for k in range(7)]
    assert sorted((r.pos, r.rule) for r in rules.theme_rules(feedback, themes).collect()) == [(k, f"rule {k}") for k in range(7)]
    got = rules.keyed_rules(feedback).collect()
    assert sorted((r.scope, r.pos) for r in got) == [(s, k) for s in ("standard", "standard_difficulty") for k in range(7)]
    assert all(r.rule.endswith(f"theme{r.pos}") for r in got)


def test_counter_examples_show_the_whole_question(spark):
    streaks = spark.createDataFrame([("S.1", "easy", "mcq", 4, [0.1])], "standard string, difficulty string, type string, streak int, last_scores array<double>")
    items = spark.createDataFrame([(1, "S.1", "easy", "mcq", "why " * 200, "A")], "ordinal long, standard string, difficulty string, type string, question string, answer string")
    stored = spark.createDataFrame([], "scope string, standard string, difficulty string, type string, pos long, rule string")
    assert [r.bad_question for r in rules.inject_negatives(streaks, items, stored)[0].collect()] == ["why " * 200]
