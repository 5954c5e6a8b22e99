"""Grade columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions import fixed_values as V


def grade_of_course(course: Column) -> Column:
    """Grade from a course name; first rule wins."""
    ordinal = F.regexp_extract(course, r"(\d+)(?:st|nd|rd|th)\s+Grade", 1)
    numbered = F.regexp_extract(course, r"Grade\s+(\d+)", 1)
    return (
        F.when(F.rlike(course, F.lit(r"^(AP |FRQ Skills - AP)")), "AP")
        .when(F.contains(course, F.lit("Kindergarten")), "K")
        .when(ordinal != "", ordinal)
        .when(numbered != "", numbered)
        .when(F.rlike(course, F.lit(r"CK Grade\s+K\b")), "K")
        .when(F.contains(course, F.lit("High School")), "HS")
        .when(F.contains(course, F.lit("SAT")), "SAT")
        .otherwise("unknown")
    )


def stored_grade(grade: Column) -> Column:
    """Bands 9-10 and 11-12 share one stored grade."""
    col = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, kept in V.GRADE_ALIASES.items():
        col = col.when(grade == name, kept)
    return col.otherwise(grade)


def grade_rank(grade: Column) -> Column:
    """Numbers before words."""
    return F.coalesce(grade.try_cast("int"), F.lit(99))
