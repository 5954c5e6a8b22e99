"""Large JSON arrays read in ranges of bytes, against Python's reader."""

import json
import random

import pytest

from itemspark.sources import json_arrays, json_text

HARD = ['}', '{', '"', '\\', '\\"', '},{', '"}', 'é€😀', '\n', '[', ']', 'plain', '\\\\', '']


def objects(n, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(HARD) for _ in range(draw.randrange(6)))
    return [{"a": i, "s": word(), "in": {"x": [word(), {"y": word()}], "z": word()}, "pad": "p" * draw.randrange(60)} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False), (None, False)])
def test_an_array_is_read_by_many_tasks(spark, tmp_path, small_splits, indent, ascii_only):
    want = objects(200)
    (tmp_path / "big.json").write_text(json.dumps(want, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    found = json_arrays.json_objects(spark, str(tmp_path)).collect()
    assert len({r._block for r in found}) > 10  # as many splits had objects
    found.sort(key=lambda r: (r._block, r._index))
    assert all(r._complete for r in found) and [json.loads(r._text) for r in found] == want


def test_objects_longer_than_a_split(spark, tmp_path, small_splits):
    want = [{"a": 1, "s": "x" * 3000, "in": [{"k": k} for k in range(300)]}, {"a": 2}, {"a": 3, "s": "}" * 2000}]
    (tmp_path / "long.json").write_text(json.dumps(want))
    found = sorted(json_arrays.json_objects(spark, str(tmp_path)).collect(), key=lambda r: (r._block, r._index))
    assert [json.loads(r._text) for r in found] == want


def test_files_of_all_kinds(spark, tmp_path, small_splits):
    (tmp_path / "one.json").write_text('{"a": 1, "s": "one"}')
    (tmp_path / "two.json").write_text(' \n[ {"a": 2} , {"a": 3, "s": null} ]\n\n')
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "cut.json").write_text('[{"a": 4}, {"a": 5, "s": "cut of')
    (tmp_path / "cut2.json").write_text('[{"a": 6}, {"a": 7, "s": "x", "in": {"b": 1}')
    (tmp_path / "text.json").write_text("no json at all } here")
    (tmp_path / "faulty.json").write_text('[{"a": 8}, {"a": nine}, {"a": 10}]')
    good = json_text.read_json_docs(spark, str(tmp_path), "a long, s string")
    assert sorted(r.a for r in good.collect()) == [1, 2, 3, 4, 6, 8, 10] and good.columns == ["a", "s", "_file"]
    bad = json_text.read_json_docs(spark, str(tmp_path), "a long, s string", keep_bad=True).filter("_parse_error").collect()
    told = sorted((r._file.rsplit("/", 1)[1], r._text) for r in bad)
    assert told == [("cut.json", '{"a": 5, "s": "cut of'), ("cut2.json", '{"a": 7, "s": "x", "in": {"b": 1}'), ("faulty.json", '{"a": nine}'), ("text.json", None)]


def test_broken_documents_of_a_column(spark):
    rows = [(1, '{"a": 1}'), (2, '[{"a": 2}, {"a": 3}]'), (3, '{"a": '), (4, "words"), (5, None), (6, "[]")]
    docs = spark.createDataFrame(rows, "id long, value string")
    assert sorted(r.a for r in json_text.json_docs(docs, "value", "a:long").collect()) == [1, 2, 3]
    assert sorted(r.id for r in json_text.broken_docs(docs, "value", "a:long").collect()) == [3, 4, 5]
