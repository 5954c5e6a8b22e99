"""Golden rows: every rejection, every issue, every repair."""

import json

import pytest
from pyspark.sql import functions as F

from itemspark.operators import bank, mend, parse, validate
from itemspark.operators.json_residue import repair

SCHEMA = (
    "ordinal long, id string, type string, standard string, difficulty string, question string, answer string, "
    "answer_options map<string,string>, acceptable_answers array<string>, answer_explanation string, image_url array<string>"
)
OPTIONS = {"A": "a red fox", "B": "a blue hen", "C": "a wild cat", "D": "an old dog"}
PASSAGE = " ".join(f"word{i}" for i in range(25))


def item(**given):
    base = dict(
        id="x", type="mcq", standard="CCSS.ELA-LITERACY.L.3.1", difficulty="easy", question="Which one runs?", answer="A",
        answer_options=OPTIONS, acceptable_answers=None, answer_explanation="Option A runs.", image_url=None,
    )
    base.update(given)
    return base


def blank(**given):
    base = dict(type="fill-in", question="The dog ______ home.", answer="ran", acceptable_answers=["ran"], answer_options=None)
    base.update(given)
    return item(**base)


def frame(spark, items):
    return spark.createDataFrame([dict(ordinal=i, **x) for i, x in enumerate(items)], SCHEMA)


REJECTS = [
    (item(), None),
    (item(answer="b"), None),
    (item(question=None, answer_explanation=None), "missing_fields:question,answer_explanation"),
    (item(answer_options=None), "missing_fields:answer_options"),
    (item(answer_options={"A": "correct choice", "B": "distractor 1", "C": "x", "D": "y"}), "placeholder"),
    (item(answer_options={"A": "a", "B": "b", "C": "c"}), "option_keys"),
    (item(answer_options={"A": "a", "B": "b", "C": "c", "E": "d"}), "option_keys"),
    (item(answer="E"), "answer_letter"),
    (item(answer_options={"a": "1", "b": "2", "c": "3", "d": "4"}), "answer_not_in_options"),
    (item(type="msq", answer="A,C"), None),
    (item(type="msq", answer="A"), "too_few_answers"),
    (item(type="msq", answer="A,B,C,D"), "too_many_answers"),
    (item(type="msq", answer="A,E"), "answer_letter"),
    (blank(), None),
    (blank(answer=" "), "blank_answer"),
    (blank(question="The dog went home."), "no_blank_cue"),
    (blank(acceptable_answers=["sat"]), "answer_not_accepted"),
    (blank(acceptable_answers=None), "answer_not_accepted"),
    (blank(acceptable_answers=["Ran "]), None),
    (blank(question="The dog ran ______ home."), "answer_beside_blank"),
    (blank(question="The dog ran ______. Word bank: ran, sat"), None),
    (blank(question="Type ran, sat, or hid. He ran ______"), None),
    (blank(standard="CCSS.ELA-LITERACY.RL.3.1", question="Read the story. It is ______"), "passage_missing"),
    (blank(standard="CCSS.ELA-LITERACY.RL.3.1", question=f"Read the story.\n{PASSAGE}\nIt is ______"), None),
    (blank(standard="CCSS.ELA-LITERACY.W.3.1", question="Read the story. It is ______"), None),
    (
        blank(standard="CCSS.ELA-LITERACY.RL.3.4", question=f"{PASSAGE} jump\nWrite the word from the text ______", answer="jumping", acceptable_answers=["jumping", "jumped"]),
        None,
    ),
    (
        blank(standard="CCSS.ELA-LITERACY.RL.3.4", question=f"{PASSAGE} jumped\nWrite the word from the text ______", answer="swam", acceptable_answers=["swam"]),
        "answer_not_in_passage",
    ),
    (
        blank(standard="CCSS.ELA-LITERACY.RL.3.4", question=f"{PASSAGE} run\nWrite the word from the text ______", answer="running", acceptable_answers=["running"]),
        None,
    ),
    (
        blank(standard="CCSS.ELA-LITERACY.RL.3.4", question=f"{PASSAGE} jumped\nAdd -ed to the word from the text ______", answer="swam", acceptable_answers=["swam"]),
        None,
    ),
]


def test_reject_reasons(spark):
    got = validate.validate_schema(frame(spark, [x for x, _ in REJECTS])).orderBy("ordinal").collect()
    assert [r.reject_reason for r in got] == [w for _, w in REJECTS]


ISSUES = [
    (item(), []),
    (item(answer_explanation="It is the hen that sings.", answer_options={**OPTIONS, "A": "some green frogs"}), ["explanation_may_not_reference_correct_option"]),
    (item(answer_explanation="Frogs are right.", answer_options={**OPTIONS, "A": "some green frogs"}), []),
    (item(question="Which word fits?"), ["stem_says_word_but_answer_is_phrase"]),
    (item(question="Look at the picture. Who runs?"), ["stem_references_image_but_no_image_url"]),
    (item(question="Look at the picture. Who runs?", image_url=["u"]), []),
    (item(question="Which choices are correct?"), ["stem_says_choices_plural_may_imply_multiple_answers"]),
    (item(answer_options={**OPTIONS, "C": "a blue hen "}), ["duplicate_option_text"]),
    (item(type="msq", answer="A,B", question="Pick some."), ["msq_stem_missing_multi_select_instruction"]),
    (item(type="msq", answer="A,B", question="Select all.", answer_options={**OPTIONS, "C": "a blue hen"}), ["duplicate_option_text"]),
    (blank(question="Use the image: ______"), ["stem_references_image_but_no_image_url"]),
    (item(answer="E"), ["answer_letter"]),
]


def test_quality_issues(spark):
    got = validate.quality_issues(frame(spark, [x for x, _ in ISSUES])).orderBy("ordinal").collect()
    assert [r.issues for r in got] == [w for _, w in ISSUES]


def test_auto_fix(spark):
    rows = [
        item(question="Which choices correctly complete it and are correct?"),
        item(question="Which word fits?"),
        item(question="Look at the picture of a dog. Who runs"),
        item(answer_options={"A": "cat", "B": "cat", "C": "cat", "D": "dog"}, answer="D", answer_explanation="option d"),
        item(answer_options={"A": "a very long option", "B": "a very long option", "C": "x", "D": "y"}, answer_explanation="option a"),
        item(answer_explanation="It sings.", answer_options={**OPTIONS, "A": "some green frogs"}),
    ]
    got = mend.auto_fix(validate.quality_issues(frame(spark, rows))).orderBy("ordinal").collect()
    assert got[0].question == "Which choice correctly completes it and is correct?"
    assert got[1].question == "Which choice fits?"
    assert got[2].question == ". Who runs?"
    # B meets the new A, so it stays equal to it for one turn
    assert got[3].answer_options == {"A": "catt", "B": "catt", "C": "cat", "D": "dog"}
    assert got[4].answer_options["A"] == "a very long option" and got[4].answer_options["B"] == "a very long option "
    assert got[5].answer_explanation == "Option A is correct because It sings."


def test_repair_takes_several_turns_for_triples(spark):
    rows = [item(answer_options={"A": "cat", "B": "cat", "C": "cat", "D": "cat"}, answer="D", answer_explanation="option d")]
    got = mend.repair_aggressively(frame(spark, rows)).collect()[0]
    assert got.issues == [] and len(set(got.answer_options.values())) == 4


def test_validate_and_fix_is_stable(spark):
    first = mend.validate_and_fix(frame(spark, [x for x, _ in ISSUES])).filter("passed").drop("issues", "passed", "was_fixed")
    again = mend.validate_and_fix(first)
    assert again.filter("not passed or was_fixed").count() == 0


def test_complete_plan(spark):
    plan = spark.createDataFrame([(i, "CCSS.ELA-LITERACY.L.3.2", "hard", t) for i, t in enumerate(["mcq", "mcq", "mcq", "fill-in", "essay"])], "plan_pos long, standard string, difficulty string, type string")
    rows = frame(spark, [item(), item(question="Which word fits?"), item(answer="E")])
    done = {r.plan_pos: r for r in mend.complete_plan(plan, rows).collect()}
    assert [done[i].outcome for i in range(5)] == ["ok", "fixed", "repaired", "constructed", "constructed"]
    assert done[3].type == "fill-in" and done[4].type == "mcq" and done[2].id == "diverse_002"


def test_bank_is_valid(spark):
    keys = spark.createDataFrame([(s, t) for s in ("L.3.1", "L.3.2", "L.3.4", "L.3.9", "RL.1.1", "RI.1.1", "RF.1.1", "SL.1.1", "W.1.1", "X.1") for t in ("mcq", "msq", "fill-in")], "s string, type string")
    keys = keys.select(F.concat(F.lit("CCSS.ELA-LITERACY."), "s").alias("standard"), "type", F.lit("easy").alias("difficulty"), F.monotonically_increasing_id().alias("ordinal"))
    made = bank.fallback_items(keys).withColumn("id", F.lit("z"))
    assert validate.quality_issues(made).filter("size(issues) > 0").count() == 0


def test_filter_accepted_answers(spark):
    rows = spark.createDataFrame([("colour", ["color", "Colour", "colour.", "hue", "col-our"]), ("big cat", ["big cats", "small cat", "cat"])], "answer string, acceptable_answers array<string>")
    got = [set(r.acceptable_answers) for r in validate.filter_accepted_answers(rows).collect()]
    assert got[0] == {"colour", "color", "Colour", "colour."}
    assert {"big cat", "big cats"} <= got[1] and "small cat" not in got[1]


# ---- parsing ----------------------------------------------------------------
GOOD = {"id": "q", "type": "mcq", "question": "Who?", "answer": "A", "answer_options": OPTIONS, "answer_explanation": "Option A.", "difficulty": "easy"}
TEXT = json.dumps(GOOD)
RESPONSES = [
    (TEXT, "native", None),
    (f"```json\n{TEXT}\n```", "native", None),
    (f"<think>a {{b}}</think>{TEXT}", "native", None),
    (f"Here {{it}} is: {TEXT} ok", "scan", None),
    (TEXT.replace("Who?", "Who\nis it?"), "control_chars", None),
    (TEXT.replace("Who?", 'Say "hi" now'), "inner_quotes", None),
    (TEXT[: TEXT.index("Option A.") + 3], "truncated", "missing_fields:difficulty"),
    (TEXT.replace("Who?", "a\\_b"), "native", None),
    (TEXT[:-1] + ', "answer": "B"}', "scan", None),
    ("no json at all", "none", "json_parse_failed"),
    ("", "none", "json_parse_failed"),
    (TEXT.replace('"answer": "A"', '"answer": "E"'), "native", None),
]


def test_parse_responses(spark):
    df = spark.createDataFrame([(i, r, "mcq") for i, (r, _, _) in enumerate(RESPONSES)], "i int, response string, expected_type string")
    got = parse.parse_responses(df).orderBy("i").collect()
    assert [r.repair_path for r in got] == [p for _, p, _ in RESPONSES]
    assert [r.reject_reason for r in got] == [w for _, _, w in RESPONSES]
    assert got[4].item.question == "Who\nis it?" and got[5].item.question == 'Say "hi" now' and got[7].item.question == "a_b"
    assert got[8].item.answer == "B" and got[11].item.answer == "D"
    assert got[6].item.answer_explanation == "(auto-filled due to truncation)"
    failures = parse.failure_table(parse.parse_responses(df)).collect()
    assert {r.reason for r in failures} == {"missing_fields:difficulty", "json_parse_failed"}


def test_fill_in_and_multi_select_forms(spark):
    rows = [
        {"type": "fill-in", "question": "q ______", "answer": "Sun", "acceptable_answers": "moon"},
        {"type": "fill-in", "question": "q ______", "answer": "sun"},
        {"type": "msq", "question": "q", "answer": ["c", "A"], "options": {"A.": "1", "(B)": "2", "C": "3", "d": "4"}},
        {"type": "msq", "question": "q", "answer": "C; a", "explanation": "why"},
        {"question": "q", "correct_answer": "2", "answer_options": {"1": "w", "2": "x", "3": "y", "4": "z"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "mcq") for i, r in enumerate(rows)], "i int, response string, expected_type string")
    got = [r.item for r in parse.parse_responses(df).orderBy("i").collect()]
    assert got[0].acceptable_answers == ["Sun", "moon"]
    assert got[1].acceptable_answers == ["sun", "SUN", "Sun"]
    assert got[2].answer == "C,A" and got[2].answer_options == {"A": "1", "B": "2", "C": "3", "D": "4"}
    assert got[3].answer == "A,C" and got[3].answer_explanation == "why"
    assert got[4].answer == "B" and got[4].id == "parsed" and got[4].type == "mcq"


@pytest.mark.parametrize(
    "text,path",
    [('{"question": "a", "x": ["p" "q"', "truncated"), ("{not json} {\"question\": 1}", "scan"), ("{{{", "none"), ('{"a": 1', "none")],
)
def test_residue(text, path):
    assert repair(text)[1] == path


def test_repair_has_no_limit():
    quoted = '{"question": "' + 'he said "go" and ' * 200 + 'left", "answer": "A"}'
    assert json.loads(repair(quoted)[0])["question"].count('"go"') == 200
    cut = '{"question": "q", "list": [' + ", ".join(f'"entry {k}"' for k in range(500)) + ', "half'
    assert json.loads(repair(cut)[0])["list"][:500] == [f"entry {k}" for k in range(500)]


@pytest.mark.parametrize(
    "text,question,path",
    [
        ('Use the form {key: value}. {"question": "Who?", "answer": "A"}', "Who?", "scan"),
        ('Use { key: [1, and then {"question": "Who?", "answer": "A"}', "Who?", "scan"),
        ('First {"id": 1}, then {"question": "Say "hi" now", "answer": "A"}', 'Say "hi" now', "inner_quotes"),
        ('Use {key: value}. {"question": "Say "hi" now", "answer": "A"}', 'Say "hi" now', "inner_quotes"),
        ('{"question": "Say "hi" now", "answer_options": {"A": "x"}} as {"id": 1}', 'Say "hi" now', "inner_quotes"),
        ('{"question": "Who?", "answer_options": {"A": "x"}, "answer": "A', "Who?", "truncated"),
    ],
)
def test_residue_prefers_the_question(text, question, path):
    got, how = repair(text)
    assert (json.loads(got)["question"], how) == (question, path)
