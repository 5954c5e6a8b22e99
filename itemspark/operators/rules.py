"""Feedback -> rules -> prompts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark import skew
from itemspark.functions import fixed_values as V
from itemspark.functions.text import has_any, one_line, short_standard, snippet, strand, strip
from itemspark.operators.joins import KEY, lookup_negatives, lookup_rules, retrieve_examples

Theme = tuple[Sequence[str], str]
_PLACE = ["scope", "standard", "difficulty", "type"]


def failure_feedback(rows: DataFrame, passing: float = V.PASS_SCORE, reason_chars: int | None = None) -> DataFrame:
    """Suggestion and reasoning of every row below the threshold or without a score."""
    reason = F.coalesce(F.nullif("reasoning", F.lit("")), F.nullif("internal_reasoning", F.lit("")))
    if reason_chars is not None:
        reason = F.substring(reason, 1, reason_chars)
    low = rows.filter(F.col("score").isNull() | (F.col("score") < passing))
    return low.select(
        "ordinal", F.coalesce("standard", F.lit("unknown")).alias("standard"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        F.coalesce("type", F.lit("mcq")).alias("type"), F.nullif(strip(F.col("suggestion")), F.lit("")).alias("suggestion"), reason.alias("reasoning"),
    )


def _snippets(feedback: DataFrame, snippet_chars: int | None) -> DataFrame:
    text = F.coalesce("suggestion", "reasoning")
    shown = one_line(text) if snippet_chars is None else snippet(text, snippet_chars)
    return feedback.filter("standard <> 'unknown'").withColumn("rule", shown).filter("rule is not null")


def theme_rules(feedback: DataFrame, themes: Sequence[Theme], max_rules: int | None = None, snippet_chars: int | None = None) -> DataFrame:
    """Rules of the themes met anywhere in the feedback, in theme order.

    One pass with one flag per theme; themes come from the caller as a short list.
    """
    low = _snippets(feedback, snippet_chars).select(F.lower("rule").alias("t"))
    flags = low.agg(*[F.coalesce(F.bool_or(has_any(F.col("t"), keys)), F.lit(False)).alias(f"h{i}") for i, (keys, _) in enumerate(themes)])
    entries = F.array(*[F.struct(F.lit(i).cast("long").alias("pos"), F.col(f"h{i}").alias("hit"), F.lit(rule).alias("rule")) for i, (_, rule) in enumerate(themes)])
    found = flags.select(F.explode(entries).alias("e")).filter("e.hit").groupBy("e.rule").agg(F.min("e.pos").alias("pos"))
    found = found.select("pos", "rule")
    return found if max_rules is None else found.orderBy("pos").limit(max_rules)


def dimension_theme_rules(dim_feedback: DataFrame, themes: dict[str, Sequence[Theme]]) -> DataFrame:
    """The same within each rubric dimension, by its own themes and without a limit."""
    listed = [(dim, keys, rule) for dim, own in themes.items() for keys, rule in own]
    low = dim_feedback.select("dim", F.lower("reasoning").alias("t"))
    flags = low.agg(
        *[
            F.coalesce(F.bool_or((F.col("dim") == dim) & has_any(F.col("t"), keys)), F.lit(False)).alias(f"h{i}")
            for i, (dim, keys, _) in enumerate(listed)
        ]
    )
    entries = F.array(
        *[
            F.struct(F.lit(i).cast("long").alias("pos"), F.lit(dim).alias("dim"), F.col(f"h{i}").alias("hit"), F.lit(rule).alias("rule"))
            for i, (dim, _, rule) in enumerate(listed)
        ]
    )
    return flags.select(F.explode(entries).alias("e")).filter("e.hit").select("e.pos", "e.dim", "e.rule")


def keyed_rules(
    feedback: DataFrame, example_keys: DataFrame | None = None, specific: DataFrame | None = None, per_standard: int | None = None,
    per_key: int | None = None, snippet_chars: int | None = None,
) -> DataFrame:
    """Rules per standard, and per full key for keys that already have an example.

    Distinct rules in the order they first appear; ``pos`` counts from 0, and is
    below ``per_standard`` and ``per_key`` where those are given. ``specific``
    (standard, rule_no, rule) holds fixed rules of a standard; they go in front,
    the last one first. The feedback is read once for both kinds.
    """
    none = F.lit(None).cast("string")
    place = lambda scope, *own: F.struct(F.lit(scope).alias("scope"), *[(F.col(c) if c in own else none).alias(c) for c in KEY])
    both = F.explode(F.array(place("standard", "standard"), place("standard_difficulty", *KEY)))
    listed = _snippets(feedback, snippet_chars).select("ordinal", "rule", both.alias("x")).select("x.*", "ordinal", "rule")
    if specific is not None:
        failed = feedback.filter("standard <> 'unknown'").select("standard").distinct()
        front = specific.join(failed, "standard", "left_semi").select("rule", (-1 - F.col("rule_no")).alias("ordinal"), place("standard", "standard").alias("x"))
        listed = listed.unionByName(front.select("x.*", "ordinal", "rule"))
    once = listed.groupBy(*_PLACE, "rule").agg(F.min("ordinal").alias("_at"))
    if example_keys is not None:
        known = example_keys.select("standard", "difficulty").distinct().withColumn("_known", F.lit(True))
        once = once.join(known, ["standard", "difficulty"], "left").filter("scope = 'standard' OR _known").drop("_known")
    if per_standard is None and per_key is None:
        numbered = once.withColumn("pos", F.row_number().over(W.partitionBy(*_PLACE).orderBy("_at", "rule")).cast("long"))
    else:
        parts = [(once.filter(F.col("scope") == scope), cap) for scope, cap in (("standard", per_standard), ("standard_difficulty", per_key))]
        most = (1 << 31) - 1
        numbered = reduce(DataFrame.unionByName, [skew.top_rows(rows, _PLACE, ["_at", "rule"], most if cap is None else cap, out="pos") for rows, cap in parts])
    return numbered.select(*_PLACE, (F.col("pos") - 1).alias("pos"), "rule")


def _null_safe(df: DataFrame) -> DataFrame:
    """Global and per-standard rules have no full key; a blank stands for the absent part."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in _PLACE})


def merge_rules(existing: DataFrame, new: DataFrame, global_cap: int | None = None, key_cap: int | None = None) -> DataFrame:
    """Add new rules to the stored ones.

    Equal is equal in all letters whatever the case; the stored text
    wins. A list over its cap, if the caller states one, keeps its end. Keys without new rules stay as they
    are (the global list is always gone over).
    """
    cols = [*_PLACE, "pos", "rule"]
    old, add = _null_safe(existing.select(*cols)), _null_safe(new.select(*cols))
    touched = add.select(*_PLACE).unionByName(old.filter("scope = 'global'").select(*_PLACE)).distinct()
    rest = old.join(touched, _PLACE, "left_anti")
    both = old.join(touched, _PLACE, "left_semi").withColumn("src", F.lit(0)).unionByName(
        add.withColumn("src", F.lit(1)).withColumn("rule", strip(F.col("rule")))
    )
    both = both.withColumn("_same", F.lower(strip(F.col("rule"))))
    once = both.groupBy(*_PLACE, "_same").agg(
        F.min(F.struct("src", "pos")).alias("at"), F.max_by("rule", F.when(F.col("src") == 0, F.col("pos"))).alias("_old"),
        F.min_by("rule", F.when(F.col("src") == 1, F.col("pos"))).alias("_new"),
    )
    flat = once.select(*_PLACE, F.coalesce("_old", "_new").alias("rule"), F.col("at.src").alias("_src"), F.col("at.pos").alias("_pos"))
    kept = None
    for is_global, cap in ((True, global_cap), (False, key_cap)):
        own = flat.filter((F.col("scope") == "global") if is_global else (F.col("scope") != "global"))
        last = own if cap is None else skew.top_rows(own, _PLACE, ["-_src", "-_pos", "rule"], cap)
        kept = last if kept is None else kept.unionByName(last)
    place = W.partitionBy(*_PLACE).orderBy("_src", "_pos")
    numbered = kept.withColumn("pos", (F.row_number().over(place) - 1).cast("long")).select(*cols)
    out = numbered.unionByName(rest.select(*cols))
    return out.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in _PLACE})


# ---- counter-examples -------------------------------------------------------
_WARNING = "Keep to the described skill:"


def inject_negatives(streaks: DataFrame, items: DataFrame, rules: DataFrame, question_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counter-examples, rules with a warning in front) for keys that keep failing.

    Keys meet by short standard, because score rows store it short. The first
    item of a key is shown; keys without an item are left alone.
    """
    short = [short_standard(F.col("standard")).alias("_short"), "difficulty", "type"]
    question = F.col("question") if question_chars is None else F.substring("question", 1, question_chars)
    shown = items.filter("question is not null and question <> ''").select(
        *short, F.struct("ordinal", question.alias("bad_question"), F.col("answer").alias("bad_answer"), "standard").alias("i")
    ).groupBy("_short", "difficulty", "type").agg(F.min("i").alias("i"))
    hit = streaks.select(*short, "streak", "last_scores").join(shown, ["_short", "difficulty", "type"])
    words = F.concat(F.lit("Failed "), F.col("streak").cast("string"), F.lit(" times in a row; do not write anything like it for "), F.col("i.standard"))
    negatives = hit.select(
        F.col("i.standard").alias("standard"), "difficulty", "type", "i.bad_question", "i.bad_answer", "streak", words.alias("instruction"), "last_scores"
    )
    warning = F.concat(
        F.lit(f"{_WARNING} the last "), F.col("streak").cast("string"), F.lit(" items for "), "standard", F.lit(" at level "), "difficulty",
        F.lit(" were scored too low ("), F.array_join(F.transform("last_scores", lambda s: s.cast("string")), ", "), F.lit(")."),
    )
    front = negatives.select(F.lit("standard_difficulty").alias("scope"), *KEY, F.lit(-1).cast("long").alias("pos"), warning.alias("rule"))
    # a key has one warning: the newest replaces those before it
    warned = front.select(*[F.col(c).alias(f"_{c}") for c in KEY])
    older = [F.col("scope") == "standard_difficulty", F.startswith("rule", F.lit(_WARNING)), *[F.col(c) == F.col(f"_{c}") for c in KEY]]
    return negatives, front.unionByName(rules.select(*front.columns).join(warned, older, "left_anti"))


def clear_resolved(negatives: DataFrame, evaluations: DataFrame, passing: float = V.PASS_SCORE) -> DataFrame:
    """Drop the counter-examples of keys that now pass."""
    passed = evaluations.filter(F.col("score") >= passing).select(
        short_standard(F.col("standard")).alias("_short"), "difficulty", "type"
    ).distinct()
    keyed = negatives.withColumn("_short", short_standard(F.col("standard")))
    return keyed.join(passed, ["_short", "difficulty", "type"], "left_anti").select(*negatives.columns)


# ---- prompts ----------------------------------------------------------------
SYSTEM_TEXTS = {
    "mcq": "You write multiple-choice questions with one correct option among A-D.",
    "msq": "You write multiple-select questions with two or three correct options among A-D.",
    "fill-in": "You write fill-in-the-blank questions with a short list of accepted answers.",
}
SCHEMA_TEXTS = {
    "mcq": '{"id": "", "type": "mcq", "question": "", "answer": "A", "answer_options": {"A": "", "B": "", "C": "", "D": ""}, "answer_explanation": "", "difficulty": ""}',
    "msq": '{"id": "", "type": "msq", "question": "", "answer": "A,C", "answer_options": {"A": "", "B": "", "C": "", "D": ""}, "answer_explanation": "", "difficulty": ""}',
    "fill-in": '{"id": "", "type": "fill-in", "question": "", "answer": "", "acceptable_answers": [""], "answer_explanation": "", "difficulty": ""}',
}
FILL_IN_GUIDES = {
    "easy": "The answer stands in the text.", "medium": "The answer needs one small step beyond the text.",
    "hard": "The answer must be inferred from several places.",
}


def _by_type(texts: dict[str, str], kind: Column, default: str = "mcq") -> Column:
    col = F.when(F.lit(False), F.lit(""))
    for name, text in texts.items():
        col = col.when(kind == name, text)
    return col.otherwise(texts[default])


def _section(title: str, lines: Column) -> Column:
    bullets = F.transform(lines, lambda x: F.concat(F.lit("• "), x))
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(bullets, "\n")))


def build_prompts(
    plan: DataFrame, standards: DataFrame, rules: DataFrame, negatives: DataFrame, examples: DataFrame, k: int = 2,
    strand_examples: DataFrame | None = None,
) -> DataFrame:
    """System and user text per distinct plan key.

    ``standards`` has standard, standard_description and (optionally) the three
    list columns; ``examples`` has the key columns, ordinal, score, user_prompt
    and example_json. Rule lists and example lists are short by their caps.
    """
    keys = plan.select(*KEY).distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda x: x["rule"])
    general = rules.filter("scope = 'global'").agg(_section("general rules", listed).alias("r"))
    own_rules = lookup_rules(keys, rules).groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "rule"))), lambda x: x["rule"]).alias("_rules")
    )
    found = retrieve_examples(keys, examples, k).withColumn("_own", F.col("example_type") == F.col("type"))
    shown = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "_own", "user_prompt", "example_json"))).alias("_e"))
    out = keys.join(standards, "standard", "left").join(own_rules, list(KEY), "left").join(shown, list(KEY), "left")
    out = lookup_negatives(keys, negatives).join(out, list(KEY))
    if strand_examples is not None:
        out = out.withColumn("strand", strand(F.col("standard"))).join(strand_examples, "strand", "left")
    kind = F.col("type")
    none = F.array().cast("array<string>")
    same = F.filter("_e", lambda e: e["_own"])
    used = F.when(F.size(same) > 0, same).otherwise(F.coalesce("_e", F.filter("_e", lambda e: F.lit(False))))
    texts = F.transform(
        used, lambda e, i: F.concat(F.lit("### Sample "), (i + 1).cast("string"), F.lit("\nRequest: "), e["user_prompt"], F.lit("\nResult: "), e["example_json"])
    )
    sample = F.when(F.size(used) > 0, F.concat(F.lit("## Samples of finished work\n"), F.array_join(texts, "\n\n")))
    system = F.concat_ws(
        "\n\n", _by_type(SYSTEM_TEXTS, kind), general.scalar(),
        F.concat(F.lit("Output schema:\n"), _by_type(SCHEMA_TEXTS, kind)), sample,
    )
    lists = []
    for name, title in (("learning_objectives", "Learning objectives"), ("assessment_boundaries", "Assessment boundaries"), ("common_misconceptions", "Common misconceptions")):
        if name in standards.columns:
            lists.append(_section(title, F.coalesce(name, none)))
    guide = F.when(kind == "fill-in", F.when(F.col("difficulty").isin(list(FILL_IN_GUIDES)), _by_type(FILL_IN_GUIDES, F.col("difficulty"), "medium")))
    avoid = F.when(
        F.col("bad_question").isNotNull(),
        F.concat(F.lit("## Do not write it like this (scored too low "), F.col("streak").cast("string"), F.lit(" times)\nQuestion: "), "bad_question",
                 F.concat(F.lit("\nAnswer: "), F.coalesce("bad_answer", F.lit("")))),
    )
    best = [F.when((kind == "fill-in") & F.col("strand_example").isNotNull(), F.concat(F.lit("## Well scored\n"), "strand_example"))] if strand_examples is not None else []
    user = F.concat_ws(
        "\n\n", F.concat(F.lit("Write one "), kind, F.lit(" question.\nStandard: "), "standard"),
        F.when(F.col("standard_description") != "", F.concat(F.lit("Description: "), "standard_description")),
        F.concat(F.lit("Difficulty: "), "difficulty"), guide, F.lit("Return only the JSON object."), *lists, *best, avoid,
        _section("reminders", F.coalesce("_rules", none)),
    )
    return out.select(
        *KEY, system.alias("system_prompt"), user.alias("user_prompt"), F.size(used).cast("long").alias("n_examples"),
        F.size(F.coalesce("_rules", none)).cast("long").alias("n_rules"),
    )


def examples_to_seed(rows: DataFrame, grade: str, subject: str = "ELA") -> DataFrame:
    """External or scored rows -> seed examples: prompt text, item JSON with options as a sorted list, key and score."""
    entries = F.transform(
        F.array_sort(F.transform(F.map_entries("answer_options"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text")))), lambda e: e
    )
    item = F.struct(
        "id", "type", "question", "answer", F.when(F.col("type") != "fill-in", entries).alias("answer_options"), "acceptable_answers",
        "answer_explanation", "difficulty", F.lit(grade).alias("grade"), "standard", F.lit(subject).alias("subject"),
    )
    prompt = F.concat(F.lit("Write one "), "type", F.lit(f" question for Grade {grade} {subject}.\nStandard: "), "standard", F.lit("\nDifficulty: "), "difficulty")
    return rows.select("ordinal", *KEY, "score", prompt.alias("user_prompt"), F.to_json(item).alias("example_json"))
