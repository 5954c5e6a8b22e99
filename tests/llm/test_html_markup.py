"""Broken markup leaves no markup in the text."""

from __future__ import annotations

import pytest

from itemspark.llm.html_text import page_text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<p><a href="x>broken</a> after</p>', "broken after"),
        ('<p><a href="x>broken</a></p><p class="y">next</p>', "broken\nnext"),
        ("<p><a href='x>one</a></p><p>it's two</p>", "one\nit's two"),
        ('<p title="a > b">kept</p>', "kept"),
        ('<p title="<b>x</b>" id=k>kept</p>', "kept"),
        ('<p data-a="1"data-b="2">kept</p>', "kept"),
        ("<p>text</p><a href=", "text"),
        ('<p>text</p><a href="never closed', "text"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>open <b>bold <i>both</p><p>next", "open bold both\nnext"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_text_of(page, text):
    assert page_text(page, {}) == text
