"""Files in, files out, the three entry points, and streams over rolled files."""

import json
import os

from pyspark.sql import functions as F

from itemspark.operators import score
from itemspark.plans import matrix, rounds, training_sets
from itemspark.sources import documents, json_text, sinks
from itemspark.streaming import streams

CHAT = {"messages": [{"role": r, "content": r + " text"} for r in ("system", "user", "assistant")], "question_id": "q1", "recipe_id": "r1"}
PAIR = {"prompt": [{"role": "user", "content": "ask"}], "chosen": {"content": "good"}, "rejected": {"content": "bad"}, "metadata": {"chosen_score": 0.95}}


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    return str(path)


def test_jsonl_keeps_or_drops_bad_lines(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", CHAT, "", "   ", '{"messages": [', PAIR)
    kept = json_text.read_jsonl(spark, path, json_text.CHAT_SCHEMA)
    assert kept.filter("_parse_error").count() == 1 and kept.count() == 3
    assert json_text.read_jsonl(spark, path, json_text.CHAT_SCHEMA, keep_bad=False).count() == 2


def test_json_docs_object_or_array(spark, tmp_path):
    write(tmp_path / "one.json", '{"a": 1}')
    write(tmp_path / "two.json", '[{"a": 2},\n {"a": 3}]')
    assert sorted(r.a for r in json_text.read_json_docs(spark, str(tmp_path), "a long").collect()) == [1, 2, 3]


def test_process_data(spark, tmp_path):
    short = {"messages": CHAT["messages"][1:]}
    write(tmp_path / "raw.jsonl", CHAT, PAIR, short, "{oops", {"other": 1})
    training_sets.process_data(spark, str(tmp_path / "raw.jsonl"), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/sft/jsonl")).collect()]
    by = {x["metadata"]["source"]: x for x in lines}
    assert len(lines) == 2
    assert by["instruction_following"]["text"].endswith("<|im_start|>assistant\nassistant text<|im_end|>\n")
    assert by["dpo_chosen"]["text"].endswith("good<|im_end|>") and by["dpo_chosen"]["metadata"]["quality_score"] == 0.95
    dpo = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/dpo/jsonl")).collect()]
    assert dpo == [{"prompt": "<|im_start|>user\nask<|im_end|>\n", "chosen": "good", "rejected": "bad", "metadata": {"chosen_score": 0.95, "rejected_score": 0.5, "difficulty": "medium"}}]
    assert spark.read.json(str(tmp_path / "out/rejected")).count() == 1


def test_curriculum_text(spark, tmp_path):
    block = "Subject: ELA\nCourse: 3rd Grade Reading\nStandard ID: {}\nStandard Description: {}\nLearning Objectives:\n{}\nAssessment Boundaries:\n* *None specified*\nCommon Misconceptions:\n* m1\n* m2\nDifficulty Definitions:\n* x"
    text = "## head\n## more\n" + "\n---\n".join([block.format("S1", "d1", "* None specified"), block.format("S1", "d2", "* o1"), block.format("S2", "*None specified*", "* o2").replace("3rd Grade", "AP")])
    path = write(tmp_path / "c.txt", text)
    from itemspark.operators import ranks

    rows = documents.read_curriculum(spark, path)
    assert rows.count() == 2
    lists = ["learning_objectives", "assessment_boundaries", "common_misconceptions"]
    one = ranks.dedupe_standards(rows, lists=lists).collect()[0]
    assert one.standard_description == "d1" and one.learning_objectives == ["o1"] and one.common_misconceptions == ["m1", "m2"] and one.grade == "3"


def test_matrix_from_files(spark, tmp_path):
    def result(scores, types):
        return json.dumps({"scores": scores, "evaluation_details": [{"index": i, "type": t, "difficulty": "easy"} for i, t in enumerate(types)]})

    write(tmp_path / "results_or_a_3_ELA.json", result([0.9, 0.5], ["mcq", "msq"]))
    write(tmp_path / "results_3_ELA_or_a_best_100_0.json", result([0.9, 0.95], ["mcq", "msq"]))
    write(tmp_path / "results_fw_b_matrix_4_ELA.json", result([0.2, None], ["mcq", "mcq"]))
    write(tmp_path / "notes.json", "{}")
    got = matrix.summarize_matrix(matrix.read_evaluations(spark, str(tmp_path)))
    rows = {r.model: r for r in got["matrix"].collect()}
    assert rows["or/a"].g3 == 100.0 and rows["or/a"].g4 is None and rows["fw/b"].g4 == 0.0
    assert [r.model for r in got["ranking"].orderBy("rank").collect()] == ["or/a", "fw/b"]


def test_close_round(spark, tmp_path):
    plan = spark.createDataFrame([(i, "CCSS.ELA-LITERACY.L.3.1", d, "mcq") for i, d in enumerate(["easy", "medium", "hard"])], "plan_pos long, standard string, difficulty string, type string")
    good = {"id": "q", "type": "mcq", "question": "Who?", "answer": "A", "answer_options": {"A": "w", "B": "x", "C": "y", "D": "z"}, "answer_explanation": "Option A.", "difficulty": "easy"}
    answers = spark.createDataFrame([(0, "m", json.dumps(good)), (1, "m", "sorry")], "plan_pos long, model string, response string")
    out = rounds.close_round(plan, answers, score.completeness_scorer(), themes=[(["x"], "r")])
    assert {r.plan_pos: r.outcome for r in out["items"].collect()} == {0: "ok", 1: "constructed", 2: "constructed"}
    assert out["failures"].count() == 1 and out["summary"].collect()[0].pass_rate == 100.0
    assert out["failed"].count() == 0 and out["rules"].count() == 0


def test_rules_document(spark):
    doc = {"global_rules": ["g1", "g2"], "by_standard": {"S": ["a"]}, "by_standard_difficulty": {"S|easy|mcq": ["b", "c"]}}
    rows = documents.read_rules(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert sorted((r.scope, r.standard, r.type, r.pos, r.rule) for r in rows.collect() if r.scope != "global") == [
        ("standard", "S", None, 0, "a"), ("standard_difficulty", "S", "mcq", 0, "b"), ("standard_difficulty", "S", "mcq", 1, "c")
    ]
    docs = [json.loads(r.value) for r in documents.rule_docs(rows).collect()]
    assert {"global_rules": ["g1", "g2"], "by_standard": {}, "by_standard_difficulty": {}} in docs


def test_payload_shape(spark):
    row = spark.sql("select 7L ordinal, 'i' id, 'mcq' type, 'S' standard, 'easy' difficulty, 'Which word fits?' question, 'b' answer, map('A','x','B','two words','C','y','D','z') answer_options, array('') acceptable_answers, 'e' answer_explanation")
    got = json.loads(sinks.export_payload(row).collect()[0].payload)
    assert got["content"]["question"] == "Which choice fits?" and got["content"]["answer"] == "B" and "acceptable_answers" not in got["content"]
    assert got["request"]["locale"] == "en-US" and got["metadata"] == {"generated_question_id": "i"} and got["image_url"] == []


# ---- scoring ----------------------------------------------------------------
def test_scoring_retries(spark):
    def scorer(item):
        if item["kind"] == "broken":
            raise RuntimeError("down")
        return {"zero": 0.0, "fine": 0.9}[item["kind"]]

    items = spark.createDataFrame([(1, "fine"), (2, "zero"), (3, "broken"), (4, "fine")], "ordinal long, kind string")
    cached = spark.createDataFrame([(4, 0.4), (9, 0.1)], "ordinal long, score double")
    got = {r.ordinal: (r.score, r.status, r.calls) for r in score.score_items(items, scorer, cached, partitions=2).collect()}
    assert got == {1: (0.9, "ok", 1), 2: (0.0, "ok", 3), 3: (None, "error", 5), 4: (0.4, "cached", 0)}


def test_scoring_in_waves(spark):
    rows = [(k, i, r, s) for i, (k, r, s) in enumerate([("a", 1, 0.9), ("a", 2, 0.99), ("b", 1, 0.1), ("b", 2, 0.95), ("c", 1, 0.2)])]
    cands = spark.createDataFrame(rows, "k string, ordinal long, rank int, own double")
    got = score.score_in_waves(cands, lambda item: item["own"], ["k"], waves=2)
    assert sorted((r.k, r["rank"]) for r in got.collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]


def test_caller_tokenizer(spark):
    from itemspark.operators import training

    got = training.encode_with(spark.createDataFrame([(1, "a b c"), (2, "a")], "id long, text string"), "id", lambda t: [len(w) + 4 for w in t.split()], max_len=2).orderBy("id").collect()
    assert got[1].input_ids == [5, 0] and got[1].labels == [5, -100] and got[0].attention_mask == [1, 1]


# ---- streams ----------------------------------------------------------------
def log(i, reason="HTTP 503", key="S1"):
    return {"ts": f"2024-01-01T00:00:{i:02d}Z", "model": "m", "standard": key, "difficulty": "easy", "reason": reason}


def test_streams_over_rolled_files(spark, tmp_path):
    src = tmp_path / "logs"
    os.makedirs(src)
    alerts = streams.threshold_alerts(str(tmp_path / "alerts"), ["model"], at_least=5)

    def run():
        streams.start(streams.read_failures(spark, str(src)), alerts, str(tmp_path / "c1"), "append").awaitTermination()
        counts = streams.failure_reasons(streams.read_failures(spark, str(src)))
        streams.start(counts, streams.append_batches(str(tmp_path / "reasons")), str(tmp_path / "c2")).awaitTermination()

    def reported():
        return sorted(r.n_since_report for r in spark.read.schema("model string, n_since_report long").parquet(str(tmp_path / "alerts/alerts")).collect())

    write(src / "1.jsonl", log(0), log(1), "broken", log(2, key="S2"))
    run()
    assert reported() == []
    write(src / "2.jsonl", log(3), log(4, "timeout"), log(5))
    run()
    assert reported() == [6]
    write(src / "3.jsonl", log(6))
    run()
    assert reported() == [6]
    now = streams.latest(spark, str(tmp_path / "reasons"), ["standard", "difficulty", "reason"])
    got = streams.repeated_keys(now).collect()
    assert [(r.standard, r.n_failures, r.top_reason) for r in got] == [("S1", 6, "HTTP 503")]


def test_stream_validation_equals_batch(spark, tmp_path):
    from test_items import REJECTS, frame

    rows = frame(spark, [x for x, _ in REJECTS])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.start(stream, streams.validated(str(tmp_path / "out")), str(tmp_path / "c"), "append").awaitTermination()
    bad = spark.read.parquet(str(tmp_path / "out/rejects"))
    assert {r.ordinal: r.reject_reason for r in bad.collect()} == {i: w for i, (_, w) in enumerate(REJECTS) if w}
    assert spark.read.parquet(str(tmp_path / "out/items")).count() == sum(w is None for _, w in REJECTS)
    assert bad.filter(F.col("batch_id") > 0).count() > 0
