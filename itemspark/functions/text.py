"""String columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V

# fixed values: the characters that count as white space, and a run of them
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(text: Column) -> Column:
    """Cut every kind of Unicode white space at both ends (``trim`` cuts only U+0020)."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def one_line(text: Column) -> Column:
    """White-space runs become one plain space; none is left at the ends."""
    return strip(F.regexp_replace(text, SPACES, " "))


def strip_chars(text: Column, chars: str) -> Column:
    """Cut any of ``chars`` at both ends."""
    return F.btrim(text, F.lit(chars))


def norm_text(text: Column) -> Column:
    """Hard and wide spaces become plain, runs collapse to one."""
    return one_line(F.translate(text, "\u00a0\u2003\u2002", "   "))


def snippet(text: Column, max_len: int = 200) -> Column:
    flat = one_line(text)
    return F.when(F.length(flat) > max_len, F.concat(F.substring(flat, 1, max_len - 3), F.lit("..."))).otherwise(flat)


def est_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def short_standard(standard: Column) -> Column:
    return F.replace(standard, F.lit(V.STANDARD_PREFIX), F.lit(""))


def capitalize(text: Column) -> Column:
    """First letter up, everything after it down (``initcap`` changes every word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483647)))


def strand(standard: Column) -> Column:
    upper = F.upper(standard)
    col = None
    for name in V.STRANDS:
        hit = F.contains(upper, F.lit(f".{name}.")) | F.startswith(upper, F.lit(name))
        col = F.when(hit, name) if col is None else col.when(hit, name)
    return col


def let(value: Column, body) -> Column:
    """Compute ``value`` once and hand it to ``body``, which may use it many times."""
    return F.transform(F.array(value), body)[0]


def built_once(make):
    """Reuse a long column that depends on column names only; building it takes many driver calls."""
    held: dict = {}

    def get():
        gateway = SparkContext._gateway
        if held.get("gateway") is not gateway:
            held.update(gateway=gateway, column=make())
        return held["column"]

    return get


def has_any(text: Column, needles: Sequence[str]) -> Column:
    """True when any of the plain needles occurs in ``text``."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def seeded_order(seed: int, *keys: Column) -> Column:
    """A repeatable pseudo-random BIGINT per key, the same after any repartition."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
