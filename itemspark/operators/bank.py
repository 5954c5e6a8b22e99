"""A small bank of stand-in items, one per (strand, sub-strand, type).

The table has a fixed number of rows and never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V
from itemspark.functions.text import short_standard

_SCHEMA = (
    "strand string, sub string, type string, question string, answer string, a string, b string, c string, d string, "
    "accepted array<string>, why string"
)


def _choice(strand, sub, kind, question, answer, options, why):
    return (strand, sub, kind, question, answer, *options, None, why)


def _blank(strand, sub, question, answer, accepted):
    return (strand, sub, "fill-in", question, answer, None, None, None, None, accepted, f"The correct answer is '{answer}'.")


ROWS = [
    _choice("L", "1", "mcq", "Which sentence has a verb that agrees with its subject?", "B",
            ("My brothers walks home.", "My brothers walk home.", "My brothers walking home.", "My brothers has walk home."),
            "Option B uses the plural verb 'walk' with the plural subject 'brothers'."),
    _choice("L", "1", "msq", "Which sentences are in the past tense? Select all that apply.", "A,D",
            ("We painted the fence.", "We paint the fence.", "We will paint the fence.", "We cleaned the yard."),
            "Options A and D tell about finished actions."),
    _blank("L", "1", "Yesterday the baker ______ twelve loaves of bread.", "baked", ["baked", "made", "sold"]),
    _choice("L", "2", "mcq", "Which line ends with the mark that a question needs?", "C",
            ("Where is my coat.", "Where is my coat!", "Where is my coat?", "Where is my coat,"),
            "Option C closes with a question mark, as every question does."),
    _choice("L", "2", "msq", "Which sentences use capital letters correctly? Select all that apply.", "A,C",
            ("Our teacher is Ms. Rivera.", "our teacher is Ms. Rivera.", "We visited Boston in May.", "We visited boston in may."),
            "Options A and C capitalize the sentence start and the names."),
    _blank("L", "2", "More than one 'leaf' is written as ______.", "leaves", ["leaves", "Leaves"]),
    _choice("L", "4", "mcq", "What does 'tiny' mean in this sentence: A tiny ant crossed the leaf?", "A",
            ("very small", "very loud", "very old", "very bright"), "Option A: an ant is very small."),
    _choice("L", "4", "msq", "Which words have a prefix that means 'not'? Select all that apply.", "B,C",
            ("replay", "unkind", "impossible", "preview"), "Options B and C start with 'un' and 'im'."),
    _blank("L", "4", "Someone who paints pictures for a living is called a ______.", "painter", ["painter", "Painter"]),
    _choice("RL", "", "mcq", "Mia hid her drawing, then smiled when the class clapped for it. How does Mia feel at the end?", "D",
            ("angry", "sleepy", "bored", "proud"), "Option D: she smiles because others like her work, so she is proud."),
    _choice("RL", "", "msq", "Sam shared his lunch and helped Leo find his cap. Which traits does Sam show? Select all that apply.", "A,B",
            ("kind", "helpful", "greedy", "careless"), "Options A and B match what Sam does."),
    _blank("RL", "", "The lesson a story teaches its readers is called its ______.", "theme", ["theme", "message", "moral"]),
    _choice("RI", "", "mcq", "Bees carry pollen from bloom to bloom, and this helps plants make seeds. What is the main idea?", "A",
            ("Bees help plants make seeds.", "Bees live in hives.", "Plants are green.", "Seeds are small."),
            "Option A states what both parts of the text explain."),
    _choice("RI", "", "msq", "Which text features help a reader find facts in a book? Select all that apply.", "A,B",
            ("index", "headings", "cover color", "paper size"), "Options A and B point the reader to facts."),
    _blank("RI", "", "At the back of a science book, hard words are explained in the ______.", "glossary", ["glossary", "Glossary"]),
    _choice("RF", "", "mcq", "Which word has the same vowel sound as 'cake'?", "B", ("cat", "rain", "car", "call"),
            "Option B has the long a sound."),
    _choice("RF", "", "msq", "Which words have two syllables? Select all that apply.", "A,C", ("garden", "house", "winter", "tree"),
            "Options A and C each have two beats."),
    _blank("RF", "", "Add a silent letter to 'cap' to spell ______.", "cape", ["cape", "Cape"]),
    _choice("SL", "", "mcq", "What should a listener do before asking a speaker a question?", "C",
            ("look away", "start a new topic", "wait for a turn", "leave the room"), "Option C keeps the talk polite."),
    _choice("SL", "", "msq", "Which actions show good listening? Select all that apply.", "A,B",
            ("facing the speaker", "nodding", "humming", "drawing on the desk"), "Options A and B show attention."),
    _blank("SL", "", "Two days before her speech, Ana went over it aloud to ______.", "practice", ["practice", "rehearse", "prepare"]),
    _choice("W", "", "mcq", "Which sentence gives an opinion?", "A",
            ("Summer is the best season.", "Summer has three months.", "July follows June.", "The sun sets late in July."),
            "Option A tells what the writer thinks."),
    _choice("W", "", "msq", "Which words help to put events in order? Select all that apply.", "A,D", ("first", "because", "purple", "next"),
            "Options A and D show the order of events."),
    _blank("W", "", "The last part of an essay is called the ______.", "conclusion", ["conclusion", "ending"]),
]


def bank_table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(ROWS, _SCHEMA)
    options = F.create_map(*[x for k, c in zip(V.OPTION_LETTERS, "abcd") for x in (F.lit(k), F.col(c))])
    return df.select(
        F.col("strand").alias("b_strand"), F.col("sub").alias("b_sub"), F.col("type").alias("b_type"),
        F.struct(
            "question", "answer", F.when(F.col("type") != "fill-in", options).alias("answer_options"),
            F.col("accepted").alias("acceptable_answers"), F.col("why").alias("answer_explanation"),
        ).alias("stand_in"),
    )


def bank_keys(standard: Column, kind: Column) -> tuple[Column, Column, Column]:
    """Strand, sub-strand and type a stand-in is looked up by, with their defaults."""
    parts = F.split(short_standard(F.coalesce(standard, F.lit(""))), r"\.")
    strand = F.when(parts[0].isin(V.STRANDS), parts[0]).otherwise("RL")
    known = sorted({sub for s, sub, *_ in ROWS if s == "L"})
    third = F.try_element_at(parts, F.lit(3))
    sub = F.when(strand == "L", F.when(third.isin(known), third).otherwise("1")).otherwise("")
    low = F.lower(F.trim(F.coalesce(kind, F.lit("mcq"))))
    return strand, sub, F.when(low.isin(V.ITEM_TYPES), low).otherwise("mcq")


def with_stand_in(df: DataFrame, standard: str = "standard", kind: str = "type") -> DataFrame:
    """Add the ``stand_in`` struct for a key."""
    strand, sub, low = bank_keys(F.col(standard), F.col(kind))
    bank = F.broadcast(bank_table(df.sparkSession))
    keyed = df.withColumns({"b_strand": strand, "b_sub": sub, "b_type": low})
    return keyed.join(bank, ["b_strand", "b_sub", "b_type"], "left").drop("b_strand", "b_sub")


def fallback_items(keys: DataFrame) -> DataFrame:
    """A valid stand-in item for every (standard, difficulty, type) key."""
    out = with_stand_in(keys)
    grade = F.col("grade") if "grade" in keys.columns else F.lit("3")
    subject = F.col("subject") if "subject" in keys.columns else F.lit("ELA")
    return out.select(
        *[c for c in keys.columns if c not in ("type", "difficulty", "grade", "subject")],
        F.col("b_type").alias("type"), F.coalesce("difficulty", F.lit("medium")).alias("difficulty"),
        F.coalesce(grade, F.lit("3")).alias("grade"), F.coalesce(subject, F.lit("ELA")).alias("subject"), "stand_in.*",
    )
