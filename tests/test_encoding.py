"""Word ids: what is shuffled to find them, and texts that are easily cut wrong."""

from pyspark.sql import functions as F

from itemspark.functions.text import WHITE, words
from itemspark.operators import training


def by_hand(texts):
    counts = {}
    for t in texts:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    return {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())), start=2)}


def encoded(df, **more):
    return {r["k"]: r for r in training.encode_sft(df, ["k"], training.build_vocabulary(df), **more).collect()}


def test_odd_texts_keep_words_and_order(spark):
    gaps = "".join(f"w{i % 7}{c}" for i, c in enumerate(WHITE))
    texts = [None, "", " \n ", "a", " a  b a ", gaps, "​x ᠎y \U0001f600", "é é é", "z" * 5000, "a " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    ids, got = by_hand(texts), encoded(df)
    for k, t in enumerate(texts):
        own = [ids[w] for w in (t or "").split()]
        gap = -len(own) % 64
        assert got[k]["input_ids"] == own + [0] * gap
        assert got[k]["attention_mask"] == [1] * len(own) + [0] * gap
        assert got[k]["labels"] == own + [-100] * gap
    assert {k: r["input_ids"] for k, r in encoded(df, max_len=2).items()} == {k: ([ids[w] for w in (t or "").split()][:2] + [0, 0])[:2] for k, t in enumerate(texts)}


def test_bytes_that_are_no_text_are_cut_as_words_are(spark):
    df = spark.sql("SELECT 1L AS k, CAST(X'61FF62206220C3' AS STRING) AS text")
    expected = {r[0] for r in df.select(F.explode(words(F.col("text")))).collect()}
    assert {r["token"] for r in training.build_vocabulary(df).collect()} == expected
    assert sorted(encoded(df)[1]["input_ids"])[-4:] == [0, 2, 3, 4]


def test_words_without_an_id_and_all_texts_without_words(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k long, text string")
    vocabulary = training.build_vocabulary(df.filter("false"))
    assert {r["k"]: r["input_ids"] for r in training.encode_sft(df, ["k"], vocabulary, max_len=3).collect()} == {1: [1, 1, 0], 2: [0, 0, 0]}
    assert [r["input_ids"] for r in training.encode_sft(df.filter("k = 2"), ["k"], vocabulary).collect()] == [[]]
    assert training.encode_sft(df.filter("false"), ["k"], vocabulary).collect() == []


def test_words_that_leave_their_text_come_back_in_place(spark, monkeypatch):
    monkeypatch.setattr(training, "_HOT", 3)
    texts = [None, "", *(" ".join(f"w{(i * j) % 50}" for j in range(i % 40)) for i in range(400)), "new new w0 new"]
    df = spark.createDataFrame([(k // 2, k % 2 or None, t) for k, t in enumerate(texts)], "a long, b int, text string")
    vocabulary = training.build_vocabulary(df.filter("text NOT LIKE 'new%'"))
    ids = by_hand(texts[:-1])
    got = {2 * r["a"] + (r["b"] or 0): r["input_ids"] for r in training.encode_sft(df, ["a", "b"], vocabulary, pad_to=1).collect()}
    assert got == {k: [ids.get(w, 1) for w in (t or "").split()] for k, t in enumerate(texts)}


def shuffled_rows(spark):
    scala, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    scala.listenerBus().waitUntilEmpty()
    none = gateway.jvm.java.util.ArrayList()
    stages = scala.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_texts_are_shuffled_once_and_frequent_words_not_at_all(spark):
    """Each different word of a text left it, and the texts moved again to meet their ids."""
    texts = [" ".join(f"w{(i * 37 + j * 7) % 1500}" for j in range(200)) for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").cache()
    vocabulary = training.build_vocabulary(df).cache()
    vocabulary.count()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        training.encode_sft(df, ["k"], vocabulary).write.format("noop").mode("overwrite").save()
        assert shuffled_rows(spark) - before <= 1000 + 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
