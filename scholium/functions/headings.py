"""Heading tests and the per-line event code behind section segmentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.constants import SECTIONS, STOP_WORDS
from scholium.functions.text import has, is_upper, let, strip, sub, uni

# Heading patterns, applied in this order.
HASH_PREFIX = uni(r"^#{1,4}\s*")
NUMBER_PREFIX = uni(r"^\d+\.?\d*\.?\s*")
ROMAN_PREFIX = uni(r"^[IVX]+\.?\s+")
TAIL_MARKS = r"[—–:\-.]+\z"
BIBLIOGRAPHY_ITEM = uni(r"^(?:\[\d+\]|\d+\.)\s+[A-Z][a-z]")
NUMBERED_HEADING = uni(r"^[IVX\d]+\.?\d*\.?\s+[A-Z]")
# The first character of whatever matches one of the two before.
NUMBER_START = uni(r"[IVX\d\[]")
APPENDIX_LETTER = uni(r"^[a-z](?:\.\d+)*\s")
ANY_DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
CANDIDATE_HASH = uni(r"^#{1,2}\s+")
CANDIDATE_NUMBER = uni(r"^\d{1,2}\s+[A-Z]")
CANDIDATE_ROMAN = uni(r"^[IVX]{1,5}\.\s+[A-Z]")

# Event codes, one character per line: a..h open a section, hard and soft stops, plain text.
SECTION_CODE = {s[0]: chr(ord("a") + i) for i, s in enumerate(SECTIONS)}
REFERENCES_CODE = SECTION_CODE["references"]
HARD_STOP, SOFT_STOP, PLAIN = "X", "s", "."


def clean_heading(line: Column) -> Column:
    s = strip(line)
    s = sub(s, HASH_PREFIX)
    s = F.replace(s, F.lit("**"), F.lit(""))
    s = sub(sub(s, NUMBER_PREFIX), ROMAN_PREFIX)
    return F.lower(strip(sub(s, TAIL_MARKS)))


def heading_rule(stripped: Column) -> Column:
    """Heading test on an already stripped line."""
    n = F.length(stripped)
    numbered = has(F.substr(stripped, F.lit(1), F.lit(1)), NUMBER_START)
    return (
        F.when(n == 0, False)
        .when(stripped.startswith("#"), True)
        .when(numbered & has(stripped, BIBLIOGRAPHY_ITEM), False)
        .when((n >= 3) & is_upper(stripped) & ~has(stripped, ANY_DIGIT), True)
        .when(numbered & has(stripped, NUMBERED_HEADING), True)
        .otherwise((n < 80) & ~stripped.endswith(".") & ~stripped.startswith("|"))
    )


def is_heading(line: Column) -> Column:
    return let(strip(line), heading_rule)


def _any_of(col: Column, words: list[str]) -> Column:
    return has(col, "|".join(words))


def has_stop_word(clean: Column) -> Column:
    return _any_of(clean, STOP_WORDS)


def is_appendix_letter(clean: Column) -> Column:
    return has(clean, APPENDIX_LETTER)


def _first_section(clean: Column, value) -> Column:
    rule = None
    for key, _, words in SECTIONS:
        cond = _any_of(clean, words)
        rule = F.when(cond, value(key)) if rule is None else rule.when(cond, value(key))
    return rule


def classify_heading(clean: Column) -> Column:
    """Section of a cleaned heading: the first section with a keyword inside it, else NULL."""
    return _first_section(clean, F.lit)


def is_strong_break(stripped: Column) -> Column:
    return stripped.startswith("#") | ((F.length(stripped) >= 3) & is_upper(stripped))


def line_code(line: Column) -> Column:
    """One-character event of a line (see the codes above)."""

    def of_heading(stripped: Column, clean: Column) -> Column:
        return (
            F.when(
                has_stop_word(clean),
                F.when(is_strong_break(stripped), HARD_STOP).otherwise(SOFT_STOP),
            )
            .when(is_appendix_letter(clean), HARD_STOP)
            .otherwise(
                F.coalesce(_first_section(clean, lambda k: F.lit(SECTION_CODE[k])), F.lit(PLAIN))
            )
        )

    return let(
        strip(line),
        lambda s: F.when(
            heading_rule(s), let(clean_heading(s), lambda c: of_heading(s, c))
        ).otherwise(PLAIN),
    )


def is_candidate_heading(stripped: Column) -> Column:
    n = F.length(stripped)
    capitals = (n >= 3) & is_upper(stripped) & ~has(stripped, ANY_DIGIT)
    return (n > 0) & (n <= 90) & (
        has(stripped, CANDIDATE_HASH)
        | capitals
        | has(stripped, CANDIDATE_NUMBER)
        | has(stripped, CANDIDATE_ROMAN)
    )
