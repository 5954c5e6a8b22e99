"""Columns over ``messages ARRAY<STRUCT<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V
from itemspark.functions.text import strip


def _turn(role: Column | str, content: Column) -> Column:
    head = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(V.CHAT_OPEN), head, F.lit("\n"), content, F.lit(V.CHAT_CLOSE))


def chat_text(messages: Column) -> Column:
    """Messages in order as one training text; other roles vanish."""
    known = F.filter(messages, lambda m: m["role"].isin(V.CHAT_ROLES))
    return F.array_join(F.transform(known, lambda m: F.concat(_turn(m["role"], m["content"]), F.lit("\n"))), "")


def reply_text(content: Column) -> Column:
    """The closing assistant turn, without a line end."""
    return _turn("assistant", content)


def last_content(messages: Column, role: str) -> Column:
    own = F.filter(messages, lambda m: m["role"] == role)
    return strip(F.try_element_at(own, F.lit(-1))["content"])


def prompt_user(prompt: Column, pick: str = "last", max_chars: int | None = None) -> Column:
    """The last (or first) user message of a prompt, else all contents in one line."""
    users = F.filter(prompt, lambda m: (m["role"] == "user"))
    chosen = F.try_element_at(users, F.lit(-1 if pick == "last" else 1))["content"]
    everything = F.array_join(F.transform(prompt, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    text = F.coalesce(F.nullif(chosen, F.lit("")), everything)
    return text if max_chars is None else F.substring(text, 1, max_chars)


def standard_in_text(text: Column) -> Column:
    by_code = F.nullif(F.regexp_extract(text, V.STANDARD_PATTERN, 1), F.lit(""))
    by_label = F.nullif(F.regexp_extract(text, V.STANDARD_LABEL_PATTERN, 1), F.lit(""))
    return F.coalesce(by_code, by_label)


def has_think(text: Column, closed: bool = False) -> Column:
    opened = F.contains(text, F.lit("<think>"))
    return opened & F.contains(text, F.lit("</think>")) if closed else opened
