"""Prompt assembly inside one row: captions, truncation, ordering, size caps, content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.constants import (
    CAPTION_HEADER, PROMPT_SECTIONS, SECTION_KEYS, TRUNCATION_MARK,
)
from scholium.functions.text import WS_SET, extract, extract_all, first_by_key, first_n, let, rstrip, strip, uni

# Caption line.
CAPTION = (
    r"(?imud)(?:^|\n)[ \t]*(?:\*{0,2})(?:Figure|Fig\.?|Table|Tbl\.|Scheme|Chart)"
    + uni(r"[ \t]+\d+[.:)]?")
    + r"(?:\*{0,2})[ \t]*([^\n]{15,})"
)
UP_TO_SENTENCE_END = rf"(?s)\A(.*[.!?][{WS_SET}])"


def captions(texts: Column, key_chars: int | None = None) -> Column:
    """Distinct figure and table captions over section texts, in order.

    Captions are equal without regard to case; ``key_chars`` compares only their opening characters.
    """
    found = F.flatten(F.transform(texts, lambda t: extract_all(t, CAPTION, 1)))
    clean = F.filter(
        F.transform(found, lambda c: F.rtrim(strip(c), F.lit("."))), lambda c: F.length(c) >= 15
    )
    return first_by_key(clean, lambda c: F.lower(c if key_chars is None else F.substr(c, F.lit(1), F.lit(key_chars))))


def smart_truncate(col: Column, limit: int) -> Column:
    """Cut at the last sentence end within ``limit``, else at a late space, else hard."""

    def cut(window: Column) -> Column:
        last_space = F.length(window) - F.instr(F.reverse(window), F.lit(" "))

        def at(sentence: Column) -> Column:
            return (
                F.when(sentence != "", rstrip(sentence))
                .when(
                    F.contains(window, F.lit(" ")) & (last_space > limit // 2),
                    rstrip(F.substr(window, F.lit(1), last_space)),
                )
                .otherwise(window)
            )

        return F.concat(let(extract(window, UP_TO_SENTENCE_END), at), F.lit(TRUNCATION_MARK))

    return F.when(F.length(col) <= limit, col).otherwise(
        let(F.substr(col, F.lit(1), F.lit(limit)), cut)
    )


def assemble(
    texts: Column, caption_list: Column, limits: bool = False, min_chars: int = 1,
    max_captions: int | None = None, max_chars: int | None = None,
) -> Column:
    """Prompt from the eight section texts (in section order); '' when there is nothing to send.

    Whole sections go in; ``limits`` cuts each at its number in PROMPT_SECTIONS, ``max_chars`` the prompt, and
    ``max_captions`` the list of captions. Where the labelled sections have fewer than ``min_chars``
    characters, all texts are sent as they are.
    """

    def chunk(key: str, label: str, limit: int) -> Column:
        content = strip(texts[SECTION_KEYS.index(key)])
        return let(
            content,
            lambda c: F.when(
                c != "", F.concat(F.lit(f"[{label}]\n"), smart_truncate(c, limit) if limits else c)
            ),
        )

    chunks = F.filter(F.array(*[chunk(*s) for s in PROMPT_SECTIONS]), lambda x: x.isNotNull())

    def cut(text: Column) -> Column:
        return text if max_chars is None else F.substr(text, F.lit(1), F.lit(max_chars))

    def body(parts: Column) -> Column:
        size = F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))
        raw = F.array_join(F.filter(texts, lambda t: strip(t) != ""), " ")
        whole = F.when(size < min_chars, raw).otherwise(F.array_join(parts, "\n\n"))
        return let(cut(whole), with_captions)

    def with_captions(text: Column) -> Column:
        block = F.array_join(
            F.transform(first_n(caption_list, max_captions), lambda c: F.concat(F.lit("- "), c)),
            "\n",
        )
        full = F.concat(text, F.lit(f"\n\n{CAPTION_HEADER}\n"), block)
        return (
            F.when(strip(text) == "", F.lit(""))
            .when(F.size(caption_list) > 0, cut(full))
            .otherwise(text)
        )

    return let(chunks, body)


def content_key(col: Column, n: int = 16) -> Column:
    return F.substr(F.sha2(col, 256), F.lit(1), F.lit(n))


def heading_list_key(headings: Column) -> Column:
    return F.concat(F.lit("hmap_"), content_key(F.array_join(headings, "|"), 12))
