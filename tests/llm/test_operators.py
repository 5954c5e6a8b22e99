"""The ten operators against SQL or plain versions, on given tables and on hard rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
from hard_rows import fixture_rows, no_rows, prose, schema, tables  # noqa: F401
import public_tokenizers
import pytest
from conftest import SMALL
from oracle_check import duck, kind, normal
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemspark.llm import html_text, line_dedup, mixing, near_duplicates, packing, quality, suffix_dedup, top_k, warc
from itemspark.llm.oracles import ORACLES
from itemspark.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    cur = duck(SMALL).execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert {c: kind(t) for c, t in df.dtypes} == {c[0]: kind(str(c[1])) for c in cur.description}
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["op8_quality_rules", "op9_line_dedup"])
def test_hard_rows_against_sql(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, tables)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), names)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, no_rows, name):
    rows = QUERIES[name](spark, no_rows).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op7_") else [])


@pytest.mark.parametrize("where", ["given", "hard"])
def test_suffix_dedup(spark, tables, fixture_rows, where):
    docs = given(spark) if where == "given" else [r[:2] for r in fixture_rows]
    got = by_id(QUERIES["op1_suffix_array_dedup"](spark, SMALL if where == "given" else tables), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.removed_bytes(docs)


def test_suffix_dedup_of_short_windows(spark, fixture_rows, schema):
    docs = spark.createDataFrame([r for r in fixture_rows if r[0] > 20], schema)
    got = by_id(suffix_dedup.remove_repeats(docs, window=64), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.removed_bytes([r[:2] for r in fixture_rows if r[0] > 20], 64)


def test_crowded_names_give_the_same(spark, tables, fixture_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "NAME_STRETCHES", 1)
    got = by_id(QUERIES["op1_suffix_array_dedup"](spark, tables), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.removed_bytes([r[:2] for r in fixture_rows])


@pytest.mark.parametrize("where", ["given", "hard"])
def test_packing(spark, tables, fixture_rows, where):
    docs = given(spark) if where == "given" else [r[:2] for r in fixture_rows]
    rows = QUERIES["op2_best_fit_packing"](spark, SMALL if where == "given" else tables).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.pieces(docs, Tokenizer.from_file(TOKENIZER))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= 2048
    assert len(bins) == brute.best_fit_bins([r.length for r in rows])


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], "doc_id long, text string")
    assert Counter(r.doc_id for r in packing.pack_documents(docs, TOKENIZER).collect()) == {1: 2, None: 1}


@pytest.mark.parametrize("where", ["given", "hard"])
def test_mixing(spark, tables, fixture_rows, where):
    folder = SMALL if where == "given" else tables
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    text = dict(given(spark) if where == "given" else [r[:2] for r in fixture_rows])
    rows = QUERIES["op4_mix_sources"](spark, folder).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(brute.words(t)) for i, t in text.items()} and len(rows) == len(text)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute.mix_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
    for s, n in want.items():
        assert abs(taken[s] - n) <= max(mixing.BLOCK_WORDS, 0.01 * n)
    again = QUERIES["op4_mix_sources"](spark, folder).collect()
    assert sorted(rows) == sorted(again)


@pytest.mark.parametrize("where", ["given", "hard"])
def test_jaccard_join(spark, tables, fixture_rows, where):
    docs = given(spark) if where == "given" else [r[:2] for r in fixture_rows]
    got = by_id(QUERIES["op5_ngram_jaccard_join"](spark, SMALL if where == "given" else tables), "n_shingles", "component_id")
    assert got == brute.components(docs, 4, 85)


def test_regions_that_must_recurse(spark, tables, fixture_rows, monkeypatch):
    """Regions of more than three sets are cut by pivots and then compared in blocks."""
    monkeypatch.setattr(near_duplicates, "REGION_SETS", 3)
    monkeypatch.setattr(near_duplicates, "_BLOCK", 2)
    got = by_id(near_duplicates.near_duplicates(spark.read.parquet(f"{tables}/documents.parquet"), width=5, percent=80), "n_shingles", "component_id")
    assert got == brute.components([r[:2] for r in fixture_rows], 5, 80)


def test_line_dedup(spark, tables, fixture_rows):
    got = by_id(QUERIES["op9_line_dedup"](spark, tables), "n_lines", "n_dropped", "kept_sha256")
    assert got == brute.line_dedup([r[:2] for r in fixture_rows])
    full = line_dedup.lines_to_drop(spark.read.parquet(f"{tables}/documents.parquet"), 40, 5, bits=1 << 20)
    loose = line_dedup.lines_to_drop(spark.read.parquet(f"{tables}/documents.parquet"), 40, 5)
    assert sorted(map(repr, full.collect())) == sorted(map(repr, loose.collect()))  # a full filter only sends more


def test_top_k_with_unfit_vectors(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, None), (4, [-0.001, 1.0]), (None, [1.0, 1.0]), (5, [])]
    fit = top_k.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in top_k.exact_top_k(fit, F.col("id") % 50 == 0, 5).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 128 * 128 + 64 * 64), (0, 2, 4, -128 + 64 * 256), (50, 1, 0, 128 * 128 + 64 * 64), (50, 2, 4, -128 + 64 * 256)]


def test_html_text(spark):
    page = (
        "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>"
        "<article><h1>Title {0}</h1><p>Tom &amp; Ann  went\n to {0} &lt;there&gt; and wrote about all of it at length.</p>"
        "<p>Second paragraph about number {0}, which is rather different from the others.</p><script>x()</script></article>"
        "<footer>All rights reserved</footer></body></html>"
    )
    rows = [(k, f"http://a.example/{k}", page.format(f"place{k}")) for k in range(6)] + [(90, None, None), (91, "http://b.example", ""), (92, "x", "plain words"), (93, "http://a.example/z", "<p>un<b>closed")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[90] == "" and got[91] == "" and got[92] == "plain words"
    for k in range(6):
        assert got[k] == f"Title place{k}\nTom & Ann went to place{k} <there> and wrote about all of it at length.\nSecond paragraph about number place{k}, which is rather different from the others."


def test_html_text_with_tasks_that_get_no_page(spark):
    rows = [(1, "http://a.example/1", "<article><p>one block</p></article>")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20, "page_id")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.page_id, r.text) for r in got] == [(1, "one block")]


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "", ""), (5, "u5", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u\r\n6", "ü€")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 33), 6: ("response", None, 5)}


def test_quality_keeps_clean_documents(spark):
    clean = "\n".join(f"Here {prose(k, 9)}." for k in range(12))
    junk = "\n".join("Home | About | Contact | Login | Help" for _ in range(40))
    got = {r.doc_id: r.text for r in quality.clean_documents(spark.createDataFrame([(1, clean), (2, junk), (3, None), (4, "")], "doc_id long, text string")).collect()}
    assert got == {1: clean}
