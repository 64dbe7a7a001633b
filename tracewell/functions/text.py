"""Words, numbers and joined text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)\s+"
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words between runs of Unicode whitespace."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_words(text: Column, limit: int) -> Column:
    """Text of at most ``limit`` words; text within the limit keeps its spacing."""
    parts = words(text)
    return F.when(F.size(parts) <= limit, text).otherwise(F.array_join(F.slice(parts, 1, limit), " "))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_A_TERM), lambda t: t != "")


def fixed(number: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounding the exact binary value half to even."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", number.cast("double"), F.lit(pattern))


def sentence(*parts: Column | str) -> Column:
    """Concatenation in which plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def identity(*parts: Column) -> Column:
    """A SHA-256 of the parts in order. They are hashed as a JSON list, so different lists never read the same."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
