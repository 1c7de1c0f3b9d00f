"""Native text expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of benchmark matching, once lower-cased: ASCII letters and digits, and everything beyond ASCII. The same class
#: stated by what it holds is twice as fast as by what it leaves out.
ALNUM = r"[0-9a-z\x80-\x{10FFFF}]++"
#: The same words before they are lower-cased.
ALNUM_ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]++"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body).getItem(0)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; text without other characters takes the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def count_chars(text: Column, pattern: str) -> Column:
    """Characters of the text that the class ``pattern`` holds."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")
