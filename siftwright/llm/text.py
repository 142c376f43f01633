"""Column builders for words and lines that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six characters that part words, and the class of them.
BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, empty when null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of other characters than BLANKS."""
    return bind(
        F.btrim(whole(text), F.lit(BLANKS)),
        lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, BLANK + "+")),
    )


def count_words(text: Column) -> Column:
    """Number of words without building them twice."""
    return F.size(words(text)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.octet_length(whole(text)).cast("long")
