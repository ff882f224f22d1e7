"""Section segmentation inside one row: no line leaves its document, so nothing is shuffled.

Every line gets a one-character event code in front; one linear regular expression then cuts
the coded text into runs (a run starts at a line that opens a section and goes on over lines
that keep it), and the runs of a section are joined. Quantifiers are possessive, so the match
is iterative and linear in the text, whatever its size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.constants import SECTION_KEYS, SECTIONS, VALID_MAP_KEYS
from scholium.functions.headings import (
    HARD_STOP, PLAIN, REFERENCES_CODE, SECTION_CODE, SOFT_STOP, clean_heading,
    has_stop_word, heading_rule, is_appendix_letter, is_candidate_heading, line_code,
)
from scholium.functions.text import (
    extract, extract_all, first_by_key, first_n, has, let, split_lines, strip, sub, uni,
)

SECTION_STRUCT = "struct<section:string,text:string,by_hash:boolean>"

RUNS = (
    rf"(?md)^(?:{REFERENCES_CODE}[^\n]*+(?:\n[{re.escape(PLAIN)}{SOFT_STOP}][^\n]*+)*+"
    rf"|[a-g][^\n]*+(?:\n\{PLAIN}[^\n]*+)*+)"
)
MAP_RUNS = rf"(?md)^[a-h][^\n]*+(?:\n\{PLAIN}[^\n]*+)*+"
CODE_AT_LINE_START = rf"(?md)^[a-h{SOFT_STOP}{re.escape(PLAIN)}]"
HASH_LINE = uni(r"^.\s*#")


def _sections_of_runs(runs: Column) -> Column:
    def one(key: str) -> Column:
        code = SECTION_CODE[key]

        def build(mine: Column) -> Column:
            return F.struct(
                F.lit(key).alias("section"),
                strip(sub(F.array_join(mine, "\n"), CODE_AT_LINE_START)).alias("text"),
                F.exists(mine, lambda r: has(r, HASH_LINE)).alias("by_hash"),
            )

        return let(F.filter(runs, lambda r: r.startswith(code)), build)

    return F.array(*[one(k) for k in SECTION_KEYS])


def section_runs(text: Column) -> Column:
    coded = F.transform(split_lines(text), lambda line: F.concat(line_code(line), line))
    return extract_all(F.array_join(coded, "\n"), RUNS, 0)


def keyword_sections(runs: Column) -> Column:
    """All eight sections, in order, empty text where absent: array of SECTION_STRUCT."""
    return _sections_of_runs(runs)


def found_count(sections: Column) -> Column:
    return F.size(F.filter(sections, lambda s: s["text"] != ""))


# --- fallback scan ---------------------------------------------------------

def _keyword_pattern(words: list[str], anchor: str) -> str:
    alternatives = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return rf"(?iu){anchor}" + uni(r"\s*(?:\d+\.?\s*)?") + f"(?:{alternatives})" + uni(
        r"\s*[\n\-—:.]"
    )


_AT_LINE = r"(?:\A|(?<!\n)\n)"
_AFTER_BREAK = r"(?<!\n)\n"
_ALL_WORDS = [w for _, _, words in SECTIONS for w in words]
#: Every keyword heading of a text, as its keyword: what has to follow it is only looked at, so that it may open the
#: next heading. No keyword is another one and a separator, so a line start has one match at most.
KEYWORD_HEADINGS = (
    rf"(?iu){_AT_LINE}" + uni(r"\s*(?:\d+\.?\s*)?")
    + f"({'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in _ALL_WORDS)})" + uni(r"(?=\s*[\n\-—:.])")
)
ANY_KEYWORD_AFTER_BREAK = _keyword_pattern(_ALL_WORDS, _AFTER_BREAK)


def _scan_section(text: Column, headings: Column, words: list[str], window: int | None) -> Column:
    """Text of the first keyword heading up to the next keyword heading, '' when none.

    ``headings`` are the keywords that head a line somewhere; only the first of ``words`` among them is searched for.
    The matched string is located by value: an earlier copy of it would itself be an earlier
    match, so its first occurrence is where the pattern matched.
    """
    def heads(word: str) -> Column:
        return F.exists(headings, lambda h: has(h, rf"(?iu)\A(?:{re.escape(word)})\z"))

    heading = F.lit("")
    for w in reversed(words):
        heading = F.when(heads(w), extract(text, _keyword_pattern([w], _AT_LINE), 0)).otherwise(heading)

    def cut(m: Column) -> Column:
        def body(tail: Column) -> Column:
            def stop(nxt: Column) -> Column:
                end = F.when(nxt == "", F.length(tail)).otherwise(F.instr(tail, nxt) - 1)
                if window is not None:
                    end = F.least(end, F.lit(window))
                return strip(F.concat(m, F.substr(tail, F.lit(1), end)))

            return let(extract(tail, ANY_KEYWORD_AFTER_BREAK, 0), stop)

        return F.when(m == "", F.lit("")).otherwise(
            let(F.substr(text, F.instr(text, m) + F.length(m)), body)
        )

    return let(heading, cut)


def scan_missing(text: Column, sections: Column, window: int | None = None) -> Column:
    """Fill empty sections by the keyword scan over the raw text; ``window`` limits their characters.

    One pass finds all keyword headings; the text is read again only for sections that one of them fills.
    """

    def filled(sections: Column, headings: Column) -> Column:
        return F.array(
            *[
                F.when(sections[i]["text"] != "", sections[i]).otherwise(
                    F.struct(
                        F.lit(key).alias("section"),
                        _scan_section(text, headings, words, window).alias("text"),
                        F.lit(False).alias("by_hash"),
                    )
                )
                for i, (key, _, words) in enumerate(SECTIONS)
            ]
        )

    return let(
        sections,
        lambda s: let(
            F.array_distinct(F.transform(extract_all(text, KEYWORD_HEADINGS), F.lower)),
            lambda hs: F.when(F.size(hs) > 0, filled(s, hs)).otherwise(s),
        ),
    )


# --- heading map -----------------------------------------------------------

def candidate_headings(text: Column, most: int | None = None) -> Column:
    """Distinct top-level heading lines (stripped) of a text, the first ``most`` if given."""
    lines = F.filter(F.transform(split_lines(text), strip), is_candidate_heading)
    return first_n(first_by_key(lines, F.lower), most)


def map_sections(text: Column, mapping: Column) -> Column:
    """Segment by a heading map: array of struct(clean, section), the last entry of a key wins."""
    codes = F.create_map(
        *[F.lit(x) for k in VALID_MAP_KEYS for x in (k, SECTION_CODE.get(k, HARD_STOP))]
    )

    def code(line: Column) -> Column:
        def of(clean: Column) -> Column:
            mapped = F.filter(mapping, lambda m: m["clean"] == clean)
            return (
                F.when(has_stop_word(clean) | is_appendix_letter(clean), HARD_STOP)
                .otherwise(
                    let(
                        mapped,
                        lambda ms: F.when(F.size(ms) == 0, PLAIN).otherwise(
                            F.coalesce(
                                F.try_element_at(codes, F.try_element_at(ms, F.lit(-1))["section"]),
                                F.lit(PLAIN),
                            )
                        ),
                    )
                )
            )

        return let(
            strip(line),
            lambda s: F.when(heading_rule(s), let(clean_heading(s), of)).otherwise(PLAIN),
        )

    coded = F.transform(split_lines(text), lambda line: F.concat(code(line), line))
    return _sections_of_runs(extract_all(F.array_join(coded, "\n"), MAP_RUNS, 0))


def merge_sections(tier1: Column, tier2: Column) -> Column:
    """(sections, tier): the map's sections override when it found more, else they fill gaps."""

    def merged(a: Column, b: Column) -> Column:
        more = found_count(b) > found_count(a)

        def pick(x: Column, y: Column) -> Column:
            use_map = (y["text"] != "") & (more | (x["text"] == ""))
            # a section of the map was not opened by a marked heading
            return F.when(use_map, y.withField("by_hash", F.lit(False))).otherwise(x)

        return F.struct(
            F.zip_with(a, b, pick).alias("sections"),
            F.when(more, 2).otherwise(1).alias("tier"),
        )

    return let(tier1, lambda a: let(tier2, lambda b: merged(a, b)))


_ASCII = [(c, rf"\x{c:02x}") for c in range(128)]
# ASCII characters by the residue of their code: odd ones, and those that leave 1 and 2 of 3
_ODD, _ONE, _TWO = ("".join(x for c, x in _ASCII if keep(c)) for keep in (lambda c: c % 2 == 1, lambda c: c % 3 == 1, lambda c: c % 3 == 2))


def points_mod_6(text: Column) -> Column:
    """Sum of all code points, modulo 6.

    ASCII characters are counted by residues of 2 and 3, which settle the one of 6; only other characters become array elements.
    """
    def count(members: str) -> Column:
        return F.length(sub(text, f"[^{members}]+"))

    others = F.aggregate(
        F.filter(F.split(sub(text, r"[\x00-\x7f]+"), ""), lambda ch: ch != ""), F.lit(0).cast("long"), lambda acc, ch: acc + F.ascii(ch))
    return F.pmod(3 * count(_ODD) + 4 * (count(_ONE) + 2 * count(_TWO)) + others, F.lit(6))


def confidence(text: Column, by_hash: Column, tier: Column, chars: int | None = None) -> Column:
    """Confidence 80..99 of a non-empty section; ``chars`` limits the characters its checksum reads."""
    n = F.size(split_lines(text))
    base = F.when(tier == 2, 88).otherwise(F.when(by_hash, 85).otherwise(70))
    bonus = F.when(n >= 20, 10).when(n >= 10, 7).when(n >= 5, 4).otherwise(2)
    points = points_mod_6(text if chars is None else F.substr(text, F.lit(1), F.lit(chars)))
    raw = base + bonus + points
    return F.greatest(F.least(raw, F.lit(99)), F.lit(80)).cast("int")
