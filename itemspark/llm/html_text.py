"""Main text of web pages by wrapper induction.

Pages become small trees of labels (tag, class and id without digits; siblings
of one label are one node, inline markup is none). As trees are matched from the
root and siblings differ in label, a node of one page is a node of another when
the labels on the way to it are the same; Spark counts the nodes of a host by
that way. A block of text that is the same on most of many pages is template, any
other one varies. The content of a page is what varies below its article or main
element or, where it has none, below the lowest box that holds most of the
varying text of pages with its nodes and no less than half of its own. So every
layout of a host has its own content node. Menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles are never content.

A page counts once for its longest block: copies of an article, whatever date or
counter they show, do not make its text template.

Cases: null or empty html and pages without varying text have an empty text; a
null URL, or one without a host, belongs to the host ''; a host of fewer than
eight different pages has no template text; repeated pages are extracted alike;
an empty table gives no rows; other columns are not read. Unclosed and wrongly
nested tags are closed as browsers do for the common cases (paragraphs, list
items, table parts). A tag whose quote is never closed ends at its first closing
bracket.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.session import durable, ship

ship(__name__)

#: A block is template when it is the same on so many different pages of a host, and on such a share of those that have its node.
CONSTANT_PAGES = 8
CONSTANT_SHARE = 0.8
#: Share of the varying text that the content node holds where there is no article, and share of the page's own.
MAIN_SHARE, OWN_SHARE = 0.8, 0.5
#: Elements that can be the content node; lists and tables are part of a text.
_BOXES = {"html", "body", "div", "section", "center"}

#: Elements of HTML by how they are read.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "td", "th",
    "math", "semantics", "annotation", "annotation-xml", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover",
    "munderover", "mmultiscripts", "mtable", "mtr", "mtd", "mstyle", "mpadded", "menclose", "mfenced",
}
_FURNITURE = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "svg", "canvas", "audio", "video", "map",
} | _RAW
#: Comment threads are furniture however long they are; the other words are not where they name most of a page.
_THREAD_WORDS = {"comment", "comments", "comentarios", "disqus", "reply", "replies", "respond"}
_FURNITURE_WORDS = _THREAD_WORDS | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "banner", "breadcrumb", "breadcrumbs", "cookie",
    "cookies", "consent", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted",
    "promotion", "related", "share", "sharing", "sidebar", "sidebars", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: Words that may stand beside those in one name ("site-header", "related-posts"); "has-sidebar" or "notice-period" name something else.
_BESIDE = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "global", "google", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "outer",
    "page", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "sticky", "text", "thread", "top", "unit", "wrap", "wrapper",
}
#: Share of a page's text from which an element is not furniture by its name alone.
MOST = 0.5
_FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: An open element of these ends when one of the others begins.
_CLOSES = {
    "p": set(), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "thead": {"tbody", "thead", "tfoot"}, "tbody": {"tbody", "thead", "tfoot"},
    "tfoot": {"tbody", "thead", "tfoot"},
}

#: A tag whose quotes are closed where a value may end; one whose quotes are not ends at the next bracket, or with the page.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^'\">])*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


def _named(name: str, words: set[str]) -> bool:
    """Whether one class or id names furniture: one of its words does, and the others only say where it stands."""
    for split in (name, re.sub(r"[A-Z]", lambda c: " " + c[0], name)):
        parts = set(_WORD.findall(split.lower()))
        if not parts.isdisjoint(words) and parts <= _FURNITURE_WORDS | _BESIDE:
            return True
    return False


def _label(tag: str, rest: str) -> tuple[str, bool, bool]:
    """Label of an element, whether it is furniture of the page, and whether its names alone say so."""
    furniture, named, names = tag in _FURNITURE, False, []
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                if tag not in ("html", "body", "article", "main"):
                    tokens = (m[2] or m[3] or m[4] or "").split()
                    named |= any(_named(t, _FURNITURE_WORDS) for t in tokens)
                    furniture |= any(_named(t, _THREAD_WORDS) for t in tokens)
                names += re.sub(r"\d+", "", value).split()
            elif name == "role":
                furniture |= value in _FURNITURE_ROLES
                names += [f"role={value}"]
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                furniture = True
    return ".".join([tag, *sorted(set(names))]), furniture, named


def _without_large(nodes: list[tuple[int, str, bool]], blocks: list[tuple[int, str]], named: set[int]) -> list[tuple[int, str, bool]]:
    """The nodes, where those that are furniture by name only are none if they hold most of the page's text."""
    chars = [0] * len(nodes)
    for node, text in blocks:
        chars[node] += len(text)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i][2] and i not in named:
            chars[i] = 0
        chars[nodes[i][0]] += chars[i]
    return [(p, label, f and not (i in named and chars[i] and chars[i] >= MOST * chars[0])) for i, (p, label, f) in enumerate(nodes)]


def read_page(page: str) -> tuple[list[tuple[int, str, bool]], list[tuple[int, str]]]:
    """Nodes (parent, label, furniture) and blocks (node, text) of a page, both in page order."""
    nodes, blocks, held = [(-1, "", False)], [], []
    by_name: set[int] = set()
    stack: list[tuple[str, int]] = [("", 0)]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def close(until: int) -> None:
        if any(t not in _INLINE or stack[i - 1][1] != n for i, (t, n) in enumerate(stack) if i >= until):
            flush()
        del stack[until:]

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = (tag or "").lower()
        if not tag:
            continue
        if closing:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), None)
            if found is not None and (tag not in _INLINE or all(t in _INLINE for t, _ in stack[found + 1 :])):
                close(found)
            elif tag in ("td", "th"):
                held.append(" ")
            continue
        label, furniture, named = _label(tag, attributes)
        inline = tag in _INLINE and not furniture and not named
        if not inline:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ("article", "section", "div", "table", "ul", "ol", "dl", "body") and tag not in ("article", "section", "div"):
                    break
                if stack[i][0] == "p" and tag not in _INLINE or tag in _CLOSES.get(stack[i][0], ()):
                    close(i)
                    break
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if inline:
            if tag in ("br", "td", "th", "wbr", "img"):
                held.append("" if tag == "wbr" else " ")
            if tag not in _VOID:
                stack.append((tag, stack[-1][1]))
            continue
        flush()
        if tag in _VOID:
            continue
        if named and not furniture:
            by_name.add(len(nodes))
        nodes.append((stack[-1][1], label, furniture or named))
        stack.append((tag, len(nodes) - 1))
    flush()
    return _without_large(nodes, blocks, by_name) if by_name else nodes, blocks


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def page_tree(nodes: list[tuple[int, str, bool]]) -> tuple[list[int], list[int], list[str], list[int]]:
    """The slot of every node (-1 in furniture), and per slot its parent, label and the hash of the labels on the way to it.

    Siblings of one label are one slot; parents come before their children.
    """
    slots, parents, labels, paths = [0], [-1], [""], [_hash("")]
    known: dict[tuple[int, str], int] = {}
    for parent, label, furniture in nodes[1:]:
        above = slots[parent]
        if above < 0 or furniture:
            slots.append(-1)
            continue
        mine = known.setdefault((above, label), len(parents))
        if mine == len(parents):
            parents.append(above)
            labels.append(label)
            paths.append(_hash(f"{paths[above]} {label}"))
        slots.append(mine)
    return slots, parents, labels, paths


def _is(label: str, name: str) -> bool:
    parts = label.split(".")
    return parts[0] == name or f"role={name}" in parts


def content_slots(parents: list[int], labels: list[str], own: list[int], usual: list[float]) -> list[bool]:
    """Which slots of a page are content; ``own`` is the varying text in each, ``usual`` that of pages having it."""
    own, usual = list(own), list(usual)
    for i in range(len(parents) - 1, 0, -1):
        own[parents[i]] += own[i]
        usual[parents[i]] += usual[i]
    tops: set[int] = set()
    for name in ("article", "main"):
        tops = tops or {i for i, label in enumerate(labels) if own[i] and _is(label, name)}
    if not tops:
        at, deeper, inner = 0, 0, set(parents)
        while deeper is not None:
            at = deeper
            deeper = next(
                (i for i in range(at + 1, len(parents)) if parents[i] == at and i in inner and labels[i].split(".")[0] in _BOXES
                 and own[i] and own[i] >= OWN_SHARE * own[0] and usual[i] >= MAIN_SHARE * usual[0]),
                None,
            )
        tops = {at}
    inside: list[bool] = []
    for i, parent in enumerate(parents):
        inside.append(i in tops or (parent >= 0 and inside[parent]))
    return inside


def page_text(page: str, facts: dict[int, tuple[float, set[int]]]) -> str:
    """The content of a page, by the facts of its host: per way the usual varying text and the template blocks."""
    nodes, blocks = read_page(page)
    slots, parents, labels, paths = page_tree(nodes)
    varying, own = [], [0] * len(parents)
    for node, text in blocks:
        slot = slots[node]
        if slot < 0:
            continue
        if paths[slot] in facts and facts[paths[slot]][1] and _hash(text) in facts[paths[slot]][1]:
            continue
        varying.append((slot, text))
        own[slot] += len(text)
    usual = [facts[path][0] if path in facts else own[i] for i, path in enumerate(paths)]
    inside = content_slots(parents, labels, own, usual)
    return "\n".join(text for slot, text in varying if inside[slot])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page a row of every slot (without a block), and one of every block."""
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            nodes, blocks = read_page(page)
            slots, _, _, paths = page_tree(nodes)
            shown = [(paths[slots[node]], text) for node, text in blocks if slots[node] >= 0]
            if not shown:
                continue
            content = _hash(max((text for _, text in shown), key=lambda t: (len(t), t)))
            rows += [(host, path, content, False, 0, 0) for path in paths]
            rows += [(host, path, content, True, _hash(text), len(text)) for path, text in shown]
        yield pd.DataFrame(rows, columns=["host", "path", "content", "is_block", "block", "chars"])


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and the ``facts`` of the ways that many different pages of it have, as JSON: one row per host that has such."""
    read = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = read.mapInPandas(_facts, "host string, path long, content long, is_block boolean, block long, chars long")
    place = ["host", "path"]
    once = rows.groupBy(*place, "is_block", "block", "content").agg(F.max("chars").alias("chars"))
    counts = durable(once.groupBy(*place, "is_block", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")))
    ways = counts.filter("not is_block").filter(F.col("n") >= CONSTANT_PAGES).select(*place, F.col("n").alias("pages"))
    often = counts.filter("is_block").filter(F.col("n") >= CONSTANT_PAGES).join(ways, place).filter(F.col("n") >= F.col("pages") * CONSTANT_SHARE)
    fixed = often.groupBy(*place).agg(F.collect_list("block").alias("fixed"), F.sum("chars").alias("fixed_chars"))
    whole = counts.filter("is_block").groupBy(*place).agg(F.sum("chars").alias("chars"))
    facts = ways.join(whole, place, "left").join(fixed, place, "left").select(
        "host", "path", ((F.coalesce("chars", F.lit(0)) - F.coalesce("fixed_chars", F.lit(0))) / F.col("pages")).alias("usual"),
        F.coalesce("fixed", F.array().cast("array<bigint>")).alias("fixed"),
    )
    return facts.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "usual", F.sort_array("fixed").alias("fixed"))))).alias("facts"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str | None, dict] = {None: {}}
    for batch in batches:
        out = []
        for page, facts in zip(batch["html"], batch["facts"], strict=True):
            if facts not in known:
                if len(known) > 1000:
                    known = {None: {}}
                known[facts] = {f["path"]: (f["usual"], set(f["fixed"])) for f in json.loads(facts)}
            out.append(page_text(page, known[facts]))
        yield batch[["page_id", "url"]].assign(text=pd.Series(out, index=batch.index, dtype=object))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    wrappers = induce_wrappers(pages)
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    spread = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.join(spread, ["host", "salt"], "left").select("page_id", "url", "html", "facts")
    id_type = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(_extract, f"page_id {id_type}, url string, text string")
