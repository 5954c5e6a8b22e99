r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<s>role\ntext</s>`` per turn. The grammar of a
body allows neither control strings nor a bare escape character, so the parser
is deterministic: bodies end at the first end mark. Conversations are rendered
plainly and parsed again; those whose turns do not come back identical are
rendered with conflicting content escaped, and parsed and compared again. A
difference after that stops the job.

Cases: null text and null role count as empty; turns are ordered by number (null
first), then role, then text, so ties and repeated rows have one order and all
stay; null ``conv_id`` is one conversation; an empty table gives no rows; extra
columns of the input are not read. A conversation is one text by definition,
so its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import let

START, END = "<s>", "</s>"
#: Strings that chat templates treat as control tokens, as one pattern.
CONTROL = r"[<\[](?=/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_end|system|user|assistant|end|endoftext|eot_id)\|>)"
_ESC = "\x1b"
TRAINED_ROLES = ("assistant",)


def escape(part: Column) -> Column:
    """Break control strings after their first character; inverse of :func:`unescape`."""
    own = F.replace(part, F.lit(_ESC), F.lit(_ESC + "e"))
    return F.regexp_replace(own, f"({CONTROL})", f"$1{_ESC}.")


def unescape(part: Column) -> Column:
    joined = F.replace(F.replace(part, F.lit(_ESC + "."), F.lit("")), F.lit(_ESC + "n"), F.lit("\n"))
    return F.replace(joined, F.lit(_ESC + "e"), F.lit(_ESC))


def _body(turn: Column, escaped: bool) -> tuple[Column, Column]:
    if not escaped:
        return turn["role"], turn["text"]
    return F.replace(escape(turn["role"]), F.lit("\n"), F.lit(_ESC + "n")), escape(turn["text"])


def _render(turns: Column, escaped: bool) -> Column:
    """A struct: the formatted text and the spans (start, length in code points) that carry loss."""

    def one(t: Column) -> Column:
        role, text = _body(t, escaped)
        return F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("text"), t["role"].isin(*TRAINED_ROLES).alias("loss"))

    def whole(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["head"]) + F.length(p["text"]) + len(END))
        ends = F.aggregate(
            lengths,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
        )["starts"]
        spans = let(ends, lambda at: F.transform(parts, lambda p, i: F.struct((F.get(at, i) + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length"), p["loss"].alias("loss"))))
        return F.struct(
            F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
            F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"),
        )

    return let(F.transform(turns, one), whole)


def parse(formatted: Column) -> Column:
    """The turns of a formatted text; null where the text breaks the grammar."""
    pieces = F.split(formatted, END, -1)

    def turns(p: Column) -> Column:
        bodies = F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))
        broken = F.exists(
            bodies,
            lambda b: ~b.startswith(START) | ~b.contains("\n") | F.substring(b, len(START) + 1, 2**31 - 1).rlike(CONTROL) | b.rlike(f"{_ESC}(?![.en])"),
        ) | (F.element_at(p, -1) != "")
        cut = lambda b: let(F.substring_index(b, "\n", 1), lambda head: F.struct(
            unescape(F.substring(head, len(START) + 1, 2**31 - 1)).alias("role"), unescape(F.substr(b, F.length(head) + 2)).alias("text")))
        return F.when(~broken, F.transform(bodies, cut))

    return let(pieces, turns)


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped texts below the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``turns``, ``formatted``, ``loss_spans``, ``escaped``."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_rows"))
    chats = chats.select("conv_id", F.transform("_rows", lambda r: F.struct(r["role"], r["text"])).alias("turns"))

    def checked(r: Column, turns: Column) -> Column:
        same = parse(r["formatted"]).eqNullSafe(turns)
        return F.when(same, r).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))

    def until_identical(plain: Column) -> Column:
        same = parse(plain["formatted"]).eqNullSafe(F.col("turns"))
        again = let(_render(F.col("turns"), True), lambda r: checked(r, F.col("turns")))
        with_flag = lambda r, flag: F.struct(r["formatted"], r["loss_spans"], F.lit(flag).alias("escaped"))
        return F.when(same, with_flag(plain, False)).otherwise(let(again, lambda r: with_flag(r, True)))

    done = chats.withColumn("_r", let(_render(F.col("turns"), False), until_identical))
    return done.select("conv_id", "turns", "_r.formatted", "_r.loss_spans", "_r.escaped")


def chat_digest(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say when they are read back."""
    texts = under_mask(F.col("formatted"), F.col("loss_spans"))
    back = chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("_turns"), F.array_join(texts, "").alias("_loss"))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
