"""Answer options: any accepted shape -> MAP<letter, text>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V

_ENTRY_LIST = "array<struct<key:string,letter:string,text:string,content:string,value:string>>"


def entry_letter(key: Column) -> Column:
    """``"A."``, ``"(C)"``, ``"b"`` and ``"1"`` all name an option."""
    raw = F.trim(key)
    letter = F.substring(F.upper(F.regexp_replace(raw, "[^A-Da-d]", "")), 1, 1)
    number = F.when(raw.isin("1", "2", "3", "4"), F.element_at(F.array(*map(F.lit, V.OPTION_LETTERS)), F.coalesce(F.when(raw.isin("1", "2", "3", "4"), raw.try_cast("int")), F.lit(1))))
    return F.coalesce(F.nullif(letter, F.lit("")), number)


def _first_text(entries: Column, letter: str) -> Column:
    own = F.filter(entries, lambda e: e["key"] == letter)
    return F.try_element_at(own, F.lit(1))["value"]


def lettered(entries: Column) -> Column:
    """First text per letter A-D as a map; letters without a text are left out."""
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), _first_text(entries, k).alias("value")) for k in V.OPTION_LETTERS]),
        lambda p: p["value"].isNotNull(),
    )
    return F.map_from_entries(pairs)


def options_map(raw: Column) -> Column:
    """Options of a VARIANT that holds a map or a list of ``{key|letter, text|content|value}``.

    A map with fewer than four entries, or one whose cleaned keys do not cover
    A-D, stays as it is, for validation to reject.
    """
    as_map = F.try_variant_get(raw, "$", "map<string,string>")
    as_list = F.try_variant_get(raw, "$", _ENTRY_LIST)
    list_entries = F.transform(
        as_list,
        lambda o: F.struct(
            F.substring(F.upper(F.trim(F.coalesce(o["key"], o["letter"], F.lit("")))), 1, 1).alias("key"),
            F.coalesce(o["text"], o["content"], o["value"], F.lit("")).alias("value"),
        ),
    )
    map_entries = F.transform(
        F.map_entries(as_map), lambda e: F.struct(entry_letter(e["key"]).alias("key"), e["value"].alias("value"))
    )
    from_map, from_list = lettered(map_entries), lettered(list_entries)
    return F.when(
        as_map.isNotNull(), F.when((F.size(as_map) >= 4) & (F.size(from_map) == 4), from_map).otherwise(as_map)
    ).when(F.size(from_list) == 4, from_list)


def letters_in(answer: Column) -> Column:
    """Distinct sorted letters of a multi-select answer."""
    found = F.regexp_extract_all(F.upper(answer), F.lit("[A-D]"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def from_wide(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four columns -> map; null when all are null."""
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in zip(V.OPTION_LETTERS, (a, b, c, d))]),
        lambda p: p["value"].isNotNull(),
    )
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))
