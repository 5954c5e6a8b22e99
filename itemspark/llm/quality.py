"""Line-first quality rules, in DataFrame functions only.

Every line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed; a document that loses too much of its text, or fails
the base rules on words, is rejected.

Cases: a null or empty text has no words and is rejected by the base rules.
Lines without a word are kept as they are and count for nothing. Repeated rows
are judged one by one; an empty table gives an empty one. The judgement is one
struct column, so other columns of the input are untouched and cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import SPACE, free_names, let, with_text, words
from itemspark.skew import settle

#: The characters counted as symbols, phrases of page furniture, and how such lines begin.
SYMBOLS = "#*$%&|<>"
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies",
    "enable javascript", "click here", "subscribe to", "sign up for", "share this", "lorem ipsum",
]
BOILERPLATE_START = ["©", "copyright", "licensed under", "spdx-license-identifier"]
SEPARATORS = "|»›•"
SENTENCE_END = [".", "!", "?", ":", ";", ",", "…", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]"]
#: Parameters of the verdict.
MAX_SYMBOLS_PER_WORD = 0.3
MAX_SEPARATORS = 3
MIN_SENTENCE_CHARS = 25
MAX_LOST = 0.5
#: Bits of a window's place in its text; longer texts take the plain sort.
_PLACE_BITS = 24


def _has(text: Column, characters: str) -> Column:
    return _any([F.contains(text, F.lit(c)) for c in characters])


def _count_of(text: Column, characters: str) -> Column:
    one = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(c)), one(c)).otherwise(0) for c in characters])


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _covered(places: Column) -> Column:
    """Words in the windows that begin at these places, which ascend."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more in the text.

    Windows are sorted by hash with their places, packed in one number; equal
    neighbours are candidates, which their whole hashes then confirm.
    """
    starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    low = (1 << _PLACE_BITS) - 1
    packed = F.transform(starts, lambda _, i: window(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

    def repeats(s: Column, of) -> Column:
        return F.filter(s, lambda x, i: of(x).eqNullSafe(of(F.get(s, i - 1))) | of(x).eqNullSafe(of(F.get(s, i + 1))))

    def places(candidates: Column) -> Column:
        whole = F.sort_array(F.transform(candidates, lambda i: F.struct(window(i).alias("h"), i.alias("p"))))
        return let(whole, lambda s: F.sort_array(F.transform(repeats(s, lambda x: x["h"]), lambda x: x["p"])))

    near = let(F.sort_array(packed), lambda s: F.transform(repeats(s, lambda x: F.shiftright(x, _PLACE_BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    every = F.transform(starts, lambda _, i: i)
    return let(let(F.when(F.size(w) <= low, near).otherwise(every), places), _covered)


def line_fails(line: Column) -> Column:
    """The rules of one line that has a word."""
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    symbols = _has(line, SYMBOLS) & (_count_of(line, SYMBOLS) > MAX_SYMBOLS_PER_WORD * n_words)
    sentence = F.substring(F.rtrim(line), -1, 1).isin(SENTENCE_END) | _any([line.contains(c + " ") for c in ".!?"])
    navigation = _has(line, SEPARATORS) & (_count_of(line, SEPARATORS) >= MAX_SEPARATORS)
    long_enough = F.length(line) >= MIN_SENTENCE_CHARS
    furniture = lambda low: _any([low.contains(x) for x in BOILERPLATE]) | _any([low.startswith(x) for x in BOILERPLATE_START])
    shouting = lambda low: long_enough & (F.upper(line) == line) & (low != line)
    return navigation | (long_enough & (symbols | ~sentence)) | let(F.lower(line), lambda low: furniture(low) | shouting(low))


def judge(text: Column) -> Column:
    """A struct: counts, ``base_failed``, ``cleaned`` (text without failing lines) and ``kept``."""
    whole = F.coalesce(text, F.lit(""))
    blank = lambda line: F.btrim(line, F.lit(SPACE)) == ""
    chars = lambda w: F.length(F.array_join(w, "")).cast("long")

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: ~blank(x))
        good = F.array_join(F.filter(lines, lambda x: blank(x) | ~line_fails(x)), "\n")
        return F.struct(let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("dup"), good.alias("good"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), chars(w).alias("chars"), _repeat_words(w).alias("rep"))

    def verdict(w: Column, s: Column) -> Column:
        base = (w["n"] < 50) | (100 * w["rep"] > 50 * w["n"])
        left = F.when(s["good"] == whole, w["chars"]).otherwise(chars(words(s["good"])))
        return F.struct(
            w["n"].alias("n_words"),
            w["chars"].alias("word_chars"),
            _count_of(whole, SYMBOLS).cast("long").alias("n_symbols"),
            s["dup"].alias("n_dup_lines"),
            w["rep"].alias("n_repeat_words"),
            base.alias("base_failed"),
            (~base & (left >= (1 - MAX_LOST) * w["chars"])).alias("kept"),
            s["good"].alias("cleaned"),
        )

    return let(let(words(text), of_words), lambda w: let(let(F.split(whole, "\n"), of_lines), lambda s: verdict(w, s)))


def quality_rules(docs: DataFrame, out: str = "quality") -> DataFrame:
    """Every document with its judgement in the struct column ``out``."""
    return docs.withColumn(out, judge(F.col("text")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; same columns.

    A generator of one row stands between judgement and filter, or the optimiser
    would copy the judgement into both filter and projection.
    """
    (name,) = free_names(docs, "quality")
    judged = settle(quality_rules(docs, name)).filter(F.col(name)["kept"])
    return with_text(judged, F.col(name)["cleaned"]).drop(name)
