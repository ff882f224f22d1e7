"""Text compression stages as column functions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.constants import BOILERPLATE_PATTERNS, COMPRESSION_LEVEL, EVIDENCE_PATTERNS
from scholium.functions.text import first_by_key, has, let, strip, sub, uni

# Marker patterns, in order. The bracketed list uses possessive loops and the
# author-year form a bounded look-behind: both match what the plain forms match, in linear time.
NUMBER_LIST = uni(r"\[\d++(?:[,;\s–\-]++\d++)*+\]")
AUTHOR_YEAR = uni(r"\((?=\w)[\w\s,.&]++(?<=[\w\s,.&]{2}\s\d{4}[a-z]?)\)")
SUPERSCRIPTS = r"[\x{b9}\x{b2}\x{b3}\x{2074}-\x{2079}]+"
BRACED_CARET = uni(r"(?<!\w)\^\{\d+(?:,\d+)*\}")
PLAIN_CARET = uni(r"(?<!\w)\^[\d,]+(?!\w)")
EMPTY_BRACKETS = uni(r"\[\s*\]")
EMPTY_PARENS = uni(r"\(\s*\)")
URL = uni(r"https?://\S+")
SENTENCE_END = uni(r"(?<=[.!?])\s+")
SPACES = uni(r"\s+")
MIN_KEY_CHARS = 10


def normalize_ws(col: Column) -> Column:
    x = F.replace(F.translate(col, "\x0c", "\n"), F.lit("﻿"), F.lit(""))
    x = sub(sub(x, r"\r\n|\r", "\n"), r"[ \t]{2,}", " ")
    return strip(sub(x, r"\n{3,}", "\n\n"))


def mask_urls(col: Column) -> Column:
    return sub(col, URL, "[URL]")


def strip_citations(col: Column) -> Column:
    x = col
    for pattern in (NUMBER_LIST, AUTHOR_YEAR, SUPERSCRIPTS, BRACED_CARET, PLAIN_CARET,
                    EMPTY_BRACKETS, EMPTY_PARENS):
        x = sub(x, pattern)
    return x


def plain_starts(pattern: str) -> list[str]:
    """Plain characters after a pattern's first one, one of which every match holds: a string for each way to go on."""
    plain = r"(?:[\w ](?![?*+{]))*"
    begin, ways = re.match(rf"(?:\[\w\w\]|\\\()({plain})(?:\(([^()]*)\)(?![?*+{{]))?", pattern).groups()
    return [begin + re.match(plain, way).group() for way in (ways or "").split("|")]


def strip_boilerplate(col: Column, evidence: bool = True) -> Column:
    """Drop filler phrases in list order; what one removes decides what the next sees.

    A pattern runs only over texts that hold one of its plain beginnings; that search decodes nothing.
    """
    def drop(pattern: str):
        def one(x: Column) -> Column:
            held = reduce(or_, [F.contains(x, F.lit(s)) for s in plain_starts(pattern)])
            return F.when(held, sub(x, uni(pattern + r"[,]?\s*"), " ")).otherwise(x)

        return one

    x = F.array(col)
    for pattern in BOILERPLATE_PATTERNS + (EVIDENCE_PATTERNS if evidence else []):
        x = F.transform(x, drop(pattern))
    x = x[0]
    x = sub(x, r" {2,}", " ")
    return F.array_join(F.transform(F.split(x, "\n", -1), strip), "\n")


def sentence_key(sentence: Column) -> Column:
    return sub(F.lower(strip(sentence)), SPACES, " ")


def sentences(col: Column) -> Column:
    return F.split(col, SENTENCE_END, -1)


def dedup_sentences(col: Column) -> Column:
    """Keep the first of equal sentences; short ones (10 characters or fewer) always stay."""
    kept = first_by_key(
        sentences(col), sentence_key, always_keep=lambda k: F.length(k) <= MIN_KEY_CHARS
    )
    return F.array_join(kept, " ")


def _letters(col: Column) -> Column:
    return F.length(sub(col, r"[^\p{L}]+"))


def drop_formula_lines(col: Column, aggressive: bool = False) -> Column:
    def keep(line: Column) -> Column:
        if aggressive:
            n = F.length(line)
            return (n < 5) | (_letters(line) / n >= 0.40)
        return (line == "") | has(line, r"\p{L}")

    lines = F.split(col, "\n", -1)
    return F.array_join(F.filter(lines, lambda l: let(strip(l), keep)), "\n")


def compress(section: Column, text: Column, mode: str = "light") -> Column:
    """Compressed text of one section; named sections have their own level, others ``mode``."""
    if mode == "off":
        return text
    if mode != "aggressive":
        mode = "light"

    def level(name: str) -> list[str]:
        return [k for k, v in COMPRESSION_LEVEL.items() if v == name and k != "references"]

    def light(x: Column, evidence: bool, aggressive: bool = False) -> Column:
        x = dedup_sentences(strip_boilerplate(x, evidence))
        if aggressive:
            x = drop_formula_lines(x, aggressive=True)
        return normalize_ws(x)

    def beyond(x: Column) -> Column:
        return (
            F.when(section.isin(level("minimal")), normalize_ws(dedup_sentences(x)))
            .when(section == "discussion", light(x, evidence=False))
            .when(section.isin(level("light")), light(x, evidence=True))
            .otherwise(light(x, evidence=True, aggressive=mode == "aggressive"))
        )

    def staged(x: Column) -> Column:
        stage1 = drop_formula_lines(strip_citations(mask_urls(x)))
        return F.when(section.isin(level("none")), x).otherwise(let(stage1, beyond))

    return F.when(section == "references", text).otherwise(let(normalize_ws(text), staged))
