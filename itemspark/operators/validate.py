"""Item validation as projections.

An item row has: ordinal, id, type, standard, difficulty, question, answer,
answer_options MAP, acceptable_answers ARRAY, answer_explanation, and optionally
image_url ARRAY, grade, subject. A null column is an absent field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V
from itemspark.functions.options import letters_in
from itemspark.functions.text import SPACES, built_once, est_tokens, has_any, let, norm_text, strip, strip_chars, words
from itemspark.skew import settle

Rule = tuple[str, Column]
_HELPERS = ["_type", "_q", "_ql", "_ans"]


def _prepared(df: DataFrame) -> DataFrame:
    q = F.coalesce("question", F.lit(""))
    out = df if "image_url" in df.columns else df.withColumn("image_url", F.lit(None).cast("array<string>"))
    return out.withColumns(
        {
            "_type": F.lower(strip(F.coalesce("type", F.lit("mcq")))), "_q": q, "_ql": F.lower(q),
            "_ans": strip(F.coalesce("answer", F.lit(""))),
        }
    )


# ---- schema rules -----------------------------------------------------------
def is_placeholder() -> Column:
    """Options that describe options instead of being some."""

    def describes(text: Column) -> Column:
        def both(a: str, b: str) -> Column:
            return F.contains(text, F.lit(a)) & F.contains(text, F.lit(b))

        repeated = F.size(F.split(text, "correct answer")) - 1
        return (
            both("correct choice", "distractor") | F.contains(text, F.lit("matches the standard"))
            | both("a correct", "an incorrect") | (both("correct answer", "incorrect answer") & (repeated >= 2))
        )

    return F.col("answer_options").isNotNull() & let(F.lower(F.array_join(F.map_values("answer_options"), " ")), describes)


def _missing(fields: Sequence[str]) -> Column:
    gone = F.filter(F.array(*[F.when(F.col(f).isNull(), f) for f in fields]), lambda x: x.isNotNull())
    return F.when(F.size(gone) > 0, F.concat(F.lit("missing_fields:"), F.array_join(gone, ",")))


def _coded(rules: Sequence[Rule]) -> list[Column]:
    return [F.when(cond, code) for code, cond in rules]


def _bad_option_keys() -> Column:
    keys = F.array_sort(F.array_distinct(F.transform(F.map_keys("answer_options"), lambda k: F.upper(strip(k)))))
    return ~keys.eqNullSafe(F.array(*map(F.lit, V.OPTION_LETTERS)))


def _msq_letters() -> Column:
    parts = F.split(F.replace(F.upper(F.col("_ans")), F.lit(" "), F.lit("")), ",")
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda p: p != ""))


def passage_text() -> Column:
    """Cleaned passage: no instruction lines, no bold lines, no punctuation."""
    lines = F.transform(F.split(F.col("_q"), "\n"), strip)

    def is_text(line: Column) -> Column:
        instruction = F.lit(False)
        for start in V.INSTRUCTION_STARTS:
            instruction = instruction | F.startswith(F.lower(line), F.lit(start))
        return (line != "") & ~instruction & ~F.startswith(line, F.lit("**"))

    def clean(line: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_replace(line, "__{2,}", " ")), V.PUNCTUATION, " ")

    joined = F.array_join(F.transform(F.filter(lines, is_text), clean), " ")
    return F.concat(F.lit(" "), F.regexp_replace(F.concat(F.lit(" "), joined), SPACES, " "), F.lit(" "))


def _word_forms(word: Column) -> Column:
    """The word, the word without a suffix, and without a doubled last letter."""
    forms = [word]
    for suffix in V.SUFFIXES:
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 2)
        forms.append(F.when(fits, stem))
        if suffix in V.DOUBLING_SUFFIXES:
            doubled = F.substring(stem, -1, 1) == F.substring(F.substring(stem, F.lit(1), F.length(stem) - 1), -1, 1)
            fits_doubled = F.endswith(word, F.lit(suffix)) & (F.length(word) > len(suffix) + 3) & doubled
            forms.append(F.when(fits_doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)))
    return F.filter(F.array(*forms), lambda f: f.isNotNull())


def answer_not_in_passage() -> Column:
    """A one-word accepted answer that the passage it should come from does not contain."""
    upper = F.upper(F.coalesce("standard", F.lit("")))
    reading = F.contains(upper, F.lit(".RL.")) | F.contains(upper, F.lit(".RI."))
    applies = reading & has_any(F.col("_ql"), V.TEXT_WORD_CUES) & ~has_any(F.col("_ql"), V.TEXT_WORD_EXCLUDED)

    def clean(entry: Column) -> Column:
        return strip_chars(F.lower(strip(entry)), "\"'.,;:!? ")

    single = F.filter(F.transform("acceptable_answers", clean), lambda e: (e != "") & (F.size(words(e)) <= 1))
    def lacks_one(text: Column) -> Column:
        found = F.forall(
            single,
            lambda e: F.exists(_word_forms(e), lambda f: F.contains(text, F.concat(F.lit(" "), f, F.lit(" ")))),
        )
        return (F.length(text) > 40) & ~found

    return F.when(applies, let(passage_text(), lacks_one)).otherwise(F.lit(False))


def passage_missing() -> Column:
    """The stem points to a text, but fewer than 20 words of text are there."""
    standard = F.coalesce("standard", F.lit(""))
    reading = standard.startswith(V.STANDARD_PREFIX + "RL") | standard.startswith(V.STANDARD_PREFIX + "RI")
    lines = F.filter(
        F.transform(F.split(F.col("_q"), "\n"), strip),
        lambda s: (s != "") & ~F.contains(s, F.lit(V.BLANK)) & ~F.startswith(s, F.lit("**")),
    )
    n_words = F.size(words(F.array_join(lines, " ")))
    return F.when(reading & has_any(F.col("_ql"), V.PASSAGE_CUES), n_words < 20).otherwise(F.lit(False))


def answer_beside_blank() -> Column:
    """A one-word answer within two words of the first blank, unless the item offers the words on purpose."""
    answer = F.lower(F.col("_ans"))
    before = F.substring_index(F.col("_q"), V.BLANK, 1)
    after = F.substring(F.col("_q"), F.length(before) + 1 + len(V.BLANK), F.lit(2147483647))
    after = F.split(after, V.HINT_START, 2)[0]
    left, right = words(before), words(after)
    left = F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), F.lit(2))
    near = F.lower(F.array_join(F.concat(left, F.slice(right, 1, 2)), " "))
    near = F.regexp_replace(F.regexp_replace(near, r"\([^)]*\)", " "), r"[,;:!?\.\'\"\*\[\]]", " ")
    beside = F.contains(F.concat(F.lit(" "), near, F.lit(" ")), F.concat(F.lit(" "), answer, F.lit(" ")))

    plain = F.regexp_replace(F.col("_q"), "[*_]", "")
    inline = F.split(F.regexp_extract(plain, V.INLINE_BANK, 1), V.INLINE_BANK_SPLIT)
    inline = F.transform(inline, lambda w: F.lower(strip_chars(strip(w), "'\"-")))
    labelled = F.split(F.regexp_extract(plain, V.LABELLED_BANK, 1), V.LABELLED_BANK_SPLIT)
    labelled = F.transform(labelled, lambda w: F.lower(strip(w)))
    early = F.lower(F.substring(before, F.lit(1), F.greatest(F.length(before) - 80, F.lit(0))))
    offered = (
        F.array_contains(inline, answer) | F.rlike(before, F.lit(V.BANK_BEFORE_BLANK)) | F.array_contains(labelled, answer)
        | F.rlike(plain, F.lit(V.VAGUE_PRONOUN))
        | (F.rlike(plain, F.lit(V.READ_CUE)) & F.contains(early, answer))
    )
    applies = F.contains(F.col("_q"), F.lit(V.BLANK)) & (F.size(words(answer)) == 1) & (F.length(answer) > 2)
    return F.when(applies & beside, ~offered).otherwise(F.lit(False))


def _reject(extra: Sequence[Rule] = ()) -> Column:
    return F.coalesce(_own_rules(), *_coded(extra)) if extra else _own_rules()


@built_once
def _own_rules() -> Column:
    upper = F.upper(F.col("_ans"))
    letters = _msq_letters()
    all_letters = F.forall(letters, lambda x: x.isin(V.OPTION_LETTERS))
    in_options = F.forall(letters, lambda x: F.array_contains(F.map_keys("answer_options"), x))
    accepted = F.transform("acceptable_answers", lambda a: F.lower(strip(a)))
    fill_in: list[Rule] = [
        ("blank_answer", F.col("_ans") == ""),
        ("no_blank_cue", ~has_any(F.col("_ql"), V.BLANK_CUES)),
        ("answer_not_accepted", ~F.coalesce(F.array_contains(accepted, F.lower(F.col("_ans"))), F.lit(False))),
        ("answer_not_in_passage", answer_not_in_passage()),
        ("passage_missing", passage_missing()),
        ("answer_beside_blank", answer_beside_blank()),
    ]
    msq: list[Rule] = [
        ("option_keys", _bad_option_keys()),
        ("too_few_answers", F.size(letters) < 2),
        ("too_many_answers", F.size(letters) > 3),
        ("answer_letter", ~all_letters),
        ("answer_not_in_options", ~in_options),
    ]
    mcq: list[Rule] = [
        ("option_keys", _bad_option_keys()),
        ("answer_letter", ~upper.isin(V.OPTION_LETTERS)),
        ("answer_not_in_options", ~F.array_contains(F.map_keys("answer_options"), upper)),
    ]
    by_type = (
        F.when(F.col("_type") == "fill-in", F.coalesce(_missing(V.FILL_IN_FIELDS), *_coded(fill_in)))
        .when(F.col("_type") == "msq", F.coalesce(_missing(V.CHOICE_FIELDS), *_coded(msq)))
        .otherwise(F.coalesce(_missing(V.CHOICE_FIELDS), *_coded(mcq)))
    )
    return F.coalesce(F.when(is_placeholder(), "placeholder"), by_type)


def validate_schema(df: DataFrame, extra: Sequence[Rule] = (), out: str = "reject_reason", skip: Column | None = None) -> DataFrame:
    """First failing rule per item, null for a valid one; ``extra`` rules run last. Rows that ``skip`` names are not looked at."""
    keep = [*df.columns]
    reason = _reject(extra) if skip is None else F.when(~skip, _reject(extra))
    return settle(_prepared(df).withColumn(out, reason).select(*keep, out))


# ---- quality rules ----------------------------------------------------------
def _option(letter: Column) -> Column:
    options = F.col("answer_options")
    return F.coalesce(F.try_element_at(options, letter), F.try_element_at(options, F.lower(letter)), F.lit(""))


def explanation_names_answer(explanation: Column, letter: Column, correct: Column) -> Column:
    """The explanation uses a key word of the right option, or its letter as a letter."""
    return let(F.lower(norm_text(explanation)), lambda text: _names_answer(text, F.lower(letter), correct))


def _names_answer(text: Column, a: Column, correct: Column) -> Column:
    by_word = F.exists(words(correct), lambda w: (F.length(w) > 2) & F.contains(text, F.lower(strip_chars(w, ".,;:!?\"'"))))
    by_letter = F.lit(False)
    for head, tail in [("option ", ""), ("choice ", ""), ("answer ", ""), ("", " is"), ("(", ")"), ("", ")."), ("answer is ", "")]:
        by_letter = by_letter | F.contains(text, F.concat(F.lit(head), a, F.lit(tail)))
    spelled = F.rlike(text, F.concat(F.lit(r"\b(option|choice|answer)\s*[:\s]*"), a, F.lit(r"\b")))
    alone = F.contains(text, F.lit("option")) & F.rlike(text, F.concat(F.lit(r"\b"), a, F.lit(r"\b")))
    return by_word | by_letter | spelled | alone


@built_once
def _quality() -> Column:
    ql = F.col("_ql")
    no_image = F.coalesce(F.size("image_url"), F.lit(0)) <= 0
    image = F.when(has_any(ql, V.IMAGE_CUES) & no_image, "stem_references_image_but_no_image_url")
    present = F.filter(
        F.transform(F.array(*map(F.lit, V.OPTION_LETTERS)), lambda k: strip(F.try_element_at(F.col("answer_options"), k))),
        lambda v: v.isNotNull(),
    )
    duplicate = F.when((F.size(present) >= 2) & (F.size(F.array_distinct(present)) < F.size(present)), "duplicate_option_text")
    letter = F.substring(F.upper(F.col("_ans")), 1, 1)
    correct, why = _option(letter), F.coalesce("answer_explanation", F.lit(""))
    long_words = F.size(F.filter(words(correct), lambda w: F.length(w) > 2))
    checked = (F.length(correct) > 3) & (why != "") & (long_words >= 2)
    unexplained = F.when(
        checked & ~explanation_names_answer(why, letter, correct), "explanation_may_not_reference_correct_option"
    )
    phrase = F.when(
        F.contains(ql, F.lit("which word")) & F.contains(strip(correct), F.lit(" ")), "stem_says_word_but_answer_is_phrase"
    )
    plural = F.when(
        has_any(ql, V.PLURAL_STEMS) & has_any(ql, V.PLURAL_CLAIMS), "stem_says_choices_plural_may_imply_multiple_answers"
    )
    unasked = F.when(~has_any(ql, V.MULTI_SELECT_CUES), "msq_stem_missing_multi_select_instruction")

    def found(*issues: Column) -> Column:
        return F.filter(F.array(*issues), lambda i: i.isNotNull())

    return (
        F.when(F.col("_type") == "fill-in", found(image))
        .when(F.col("_type") == "msq", found(unasked, duplicate, image))
        .otherwise(found(unexplained, phrase, image, plural, duplicate))
    )


def quality_issues(
    df: DataFrame, extra: Sequence[Rule] = (), out: str = "issues", known_reject: str | None = None
) -> DataFrame:
    """All issues of an item; a schema rejection is the only issue reported.

    ``known_reject`` names a column that already holds the schema reason.
    """
    keep = [c for c in df.columns if c != out]
    reason = known_reject or "_reject"
    checked = _prepared(df.drop(out))
    if known_reject is None:
        checked = checked.withColumn(reason, _reject(extra))
    issues = F.when(F.col(reason).isNotNull(), F.array(reason)).otherwise(_quality())
    return settle(checked.withColumn(out, issues).select(*keep, out))


def validation_report(df: DataFrame) -> DataFrame:
    """Totals, and the count of every issue."""
    checked = quality_issues(df)
    label = F.explode(
        F.concat(
            F.array(F.lit("total"), F.when(F.size("issues") == 0, "passed").otherwise("failed")),
            F.transform("issues", lambda i: F.concat(F.lit("issue:"), i)),
        )
    ).alias("label")
    return checked.select(label).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def failing_items(df: DataFrame) -> DataFrame:
    return quality_issues(df).filter(F.size("issues") > 0).select("ordinal", "id", "standard", "issues")


def over_length(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Flag the text columns whose estimated tokens exceed their limit."""
    flags = {f"{c}_over": est_tokens(F.coalesce(c, F.lit(""))) > limit for c, limit in limits.items()}
    return df.withColumns(flags)


def filter_accepted_answers(df: DataFrame) -> DataFrame:
    """Keep accepted answers that are spelling variants of the answer.

    The result is the sorted set of the answer, its variants, and case forms
    when fewer than three remain.
    """
    ans = strip(F.col("answer"))
    low, n_words = F.lower(ans), F.size(words(F.lower(ans)))

    def bare(text: Column) -> Column:
        return F.rtrim(text, F.lit(".,!?;:"))

    def close(entry: Column) -> Column:
        e = F.lower(entry)
        same = (e == low) | (bare(e) == bare(low))
        foreign = (F.contains(entry, F.lit("'")) & ~F.contains(ans, F.lit("'"))) | (
            F.contains(entry, F.lit("-")) & ~F.contains(ans, F.lit("-"))
        )
        distance = F.levenshtein(low, e)
        long = F.length(low) >= 6
        ratio = distance / F.greatest(F.length(low), F.lit(1))
        near_word = (distance <= F.when(long, 2).otherwise(1)) & (ratio <= F.when(long, 0.34).otherwise(0.20))
        pairs = F.arrays_zip(words(low).alias("a"), words(e).alias("b"))
        near_all = F.forall(
            pairs,
            lambda p: (F.levenshtein(p["a"], p["b"]) <= 2)
            & (F.levenshtein(p["a"], p["b"]) / F.greatest(F.length(p["a"]), F.lit(1)) <= 0.4),
        )
        sized = F.size(words(e)) == n_words
        return same | (~foreign & sized & F.when(n_words == 1, near_word).otherwise(near_all))

    kept = F.array_distinct(F.concat(F.array(ans), F.filter(F.transform("acceptable_answers", strip), close)))
    capital = F.concat(F.upper(F.substring(ans, 1, 1)), F.lower(F.substring(ans, 2, 2147483647)))
    padded = F.array_distinct(F.concat(kept, F.array(low, capital, F.upper(ans))))
    result = F.array_sort(F.when(F.size(kept) < 3, padded).otherwise(kept))
    return df.withColumn("acceptable_answers", F.when(ans != "", result).otherwise(F.col("acceptable_answers")))


def answer_letters(answer: Column) -> Column:
    return letters_in(answer)
