"""Column expressions on strings. All stay in the JVM; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that is neither a letter nor a digit separates words.
SEPARATORS = r"[^\p{L}\p{Nd}]+"


def term(value: Column) -> Column:
    """The words of a string in lower case, joined by single blanks; '' for a string without words."""
    return F.trim(F.lower(F.regexp_replace(value, SEPARATORS, " ")))


def words(value: Column) -> Column:
    """The words of a string as an array; an empty array for a string without words. The text is searched once."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(value, SEPARATORS, " ")), " "), "")


def has_words(value: Column) -> Column:
    """True for strings with at least one word; false for null."""
    return F.coalesce(value.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))
