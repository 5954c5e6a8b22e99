"""Text of pages that a list of names, one layout of the host, or copies must not cost."""

from __future__ import annotations

import pytest

from itemspark.llm import html_text

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("names", ["id=content class='has-sidebar'", "class=no-comments", "class='post with-header'", "class=share-enabled", "id=notice-period", "class=widget"])
def test_names_do_not_cost_an_article(spark, names):
    page = f"<body><nav>Menu</nav><div {names}><p>First words of it.</p><p>More words of it.</p></div><div class='site-footer'>Imprint</div></body>"
    assert texts(spark, [(1, "http://a.example/1", page)]) == {1: "First words of it.\nMore words of it."}


def test_edits_and_formulas_stay(spark):
    page = "<article><p>It is <del>two</del> <ins>three</ins> of <math><mi>x</mi><mo>+</mo><mn>1</mn></math> parts.</p><fieldset><legend>Case</legend>All of it.</fieldset><ins class=adsbygoogle>Buy</ins></article>"
    assert texts(spark, [(1, "http://a.example/1", page)]) == {1: "It is two three of x+1 parts.\nCase\nAll of it."}


def test_every_layout_of_a_host_has_its_own_content(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><article><h1>Title {k}</h1><p>Long words of the article numbered {k}, and more of them.</p></article></body>") for k in range(20)]
    rows += [(100 + k, f"http://a.example/{k}", f"<body><div class=content><h1>Other {k}</h1><p>Words of another layout, number {k}.</p></div></body>") for k in range(9)]
    rows += [(200 + k, f"http://a.example/{k}", f"<body><div class=old><p>Short {k}</p></div></body>") for k in range(3)]
    rows += [(93, "http://a.example/z", "<p>un<b>closed"), (94, None, "<article>one</article>"), (95, "nowhere", "<div><p>without a host</p></div>")]
    got = texts(spark, rows)
    assert got[7] == "Title 7\nLong words of the article numbered 7, and more of them."
    assert [got[100 + k] for k in range(9)] == [f"Other {k}\nWords of another layout, number {k}." for k in range(9)]
    assert [got[200 + k] for k in range(3)] == [f"Short {k}" for k in range(3)]
    assert (got[93], got[94], got[95]) == ("unclosed", "one", "without a host")


def test_small_layouts_without_an_article(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><div class=big><h1>Title {k}</h1><p>{f'Long words {k}. ' * 20}</p></div></body>") for k in range(30)]
    rows += [(100, "http://a.example/s", "<body><div class=small><h2>Rare</h2><p>Few words here.</p></div></body>")]
    assert texts(spark, rows)[100] == "Rare\nFew words here."


def test_copies_do_not_make_an_article_template(spark):
    rows = [(k, f"http://a.example/{k}", f"<article><h1>Title {k}</h1><p>Own words of page {k}, which are long enough.</p></article>") for k in range(10)]
    copied = "<article><h1>Copied</h1><table><tr><td>cell</td></tr></table><p>Words that many pages copy from each other.</p><time>{0}</time></article>"
    rows += [(100 + k, f"http://a.example/c{k}", copied.format(f"day {k}")) for k in range(12)]
    rows += [(200 + k, f"http://b.example/{k}", copied.format(f"day {k}")) for k in range(12)]
    got = texts(spark, rows)
    for k in range(12):
        assert got[100 + k] == got[200 + k] and got[200 + k].startswith("Copied\ncell\nWords that many pages copy from each other.") and got[200 + k].endswith(f"day {k}")


def test_a_notice_among_paragraphs_is_template_although_one_page_deviates(spark):
    page = "<article><p>Reprinted by permission.</p><p>Own words of page {0}, which are long enough.</p></article><div><p>{1}</p></div>"
    rows = [(k, f"http://a.example/{k}", page.format(k, "All prices include tax.")) for k in range(12)] + [(50, "http://a.example/x", "<article><p>A page without the notice at all.</p></article>")]
    got = texts(spark, rows)
    assert [got[k] for k in range(12)] == [f"Own words of page {k}, which are long enough." for k in range(12)]
    assert got[50] == "A page without the notice at all."
