"""Text, number and display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, with the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(text: Column) -> Column:
    """Drop white space of any kind at both ends (plain ``trim`` drops blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def to_int(text: Column) -> Column:
    """Whole number or null; ``1.0`` is not a whole number here."""
    return strip_space(text).try_cast("int")


def binary_decision(text: Column) -> Column:
    """1 where the reply is the whole number one (``1``, `` +1 ``, ``01``), else 0; a missing reply is 0."""
    digits = F.translate(strip_space(text), "０１", "01")
    return F.when(digits.rlike(r"^\+?(?:0_?)*1$"), 1).otherwise(0)


def names_language_model(label: Column, strict: bool = False) -> Column:
    """Whether a method label counts as a large language model; null counts as no.

    The loose test is a case-sensitive substring test, so ``Transformer-based (Non-LLM)``
    passes it. ``strict`` looks for ``Large Language`` only.
    """
    found = label.contains("Large Language")
    if not strict:
        found = found | label.contains("LLM")
    return F.coalesce(found, F.lit(False))


def language_model_label(label: Column, strict: bool = False) -> Column:
    return F.when(names_language_model(label, strict), "LLM").otherwise("Non-LLM")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a raw double, null where ``whole`` is 0."""
    return F.try_divide(part, whole) * 100


def one_decimal(value: Column) -> Column:
    """Round a non-negative double to one decimal by its exact binary value, ties to even.

    This is how C-family formatting rounds. ``20 * value`` is compared with the odd number
    half-way between two tenths; the two subtractions below are exact in doubles.
    """
    tenths = F.floor(value * 10).cast("double")
    middle = tenths * 2 + 1
    above = value * 4 - (middle - value * 16)
    even = F.pmod(tenths, F.lit(2.0)) == 0
    up = (above > 0) | ((above == 0) & ~even)
    return F.when(up, tenths + 1).otherwise(tenths) / 10


def show_percent(value: Column) -> Column:
    return F.format_string("%5.1f", one_decimal(value))


def text_bar(pct: Column) -> Column:
    """One block for every two full percent."""
    return F.repeat(F.lit("█"), F.floor(pct / 2).cast("int"))


def pad_with(text: Column, width: int, fill: str) -> Column:
    """Fill up on the right; longer text stays whole (``rpad`` would cut it)."""
    return F.concat(text, F.repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.length(text))))


def file_key(label: Column) -> Column:
    """Label as a file name: ``/`` becomes ``-`` and a blank becomes ``_``."""
    return F.translate(label, "/ ", "-_")
