"""Reference lists inside one row: lines, identifiers, titles, years, recency, duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.constants import MIN_REF_CHARS, NEUTRAL_SCORE
from scholium.functions.text import (
    empty_strings, extract, extract_all, first_n, has, let, repeats_by_key, round_exact, split_lines,
    strip, sub, uni,
)

# Identifier, year and title patterns.
QUOTES = "‘’“”"
DOI_LABELLED = r"(?iu)" + uni(r"(?:doi\.org/|DOI:\s*|doi:\s*)(10\.\d{4,}/\S+)")
DOI_STANDALONE = r"(?iu)" + uni(r"(?<!\w)(10\.\d{4,9}/[^\s,;)\]>'\"`" + QUOTES + r"]+)")
DOI_IN_LINK = uni(r"(10\.\d{4,9}/[^\s,;)\]>'\"]+)")
TRAILING_JUNK = r"[.,;:>'\"`\\\-" + QUOTES + r"]+\z"
YEAR = uni(r"(?<!\w)(19\d{2}|20\d{2})(?!\w)")
ARXIV = r"(?iu)" + uni(
    r"(?:arXiv\s*(?:preprint\s*arXiv)?\s*:|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})"
)
NUMBERING = uni(r"\A\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s*")
QUOTED = r"[\"“]([^\n]+?)[\"”]"
AFTER_YEAR_PARENS = uni(r"\(\d{4}\)\.?\s*([^\n]+?)\.")
AFTER_YEAR = uni(r"\d{4}[.,]\s*([^\n]+?)\.")
LABEL = uni(r"\A([A-Z][a-z]+(?:\s+(?:et\s+al\.?|&\s+\w+))?[^\n]*?\d{4})")
HREF = r"href=\"([^\"]*)\""


def ref_lines(refs: Column) -> Column:
    return F.filter(
        F.transform(split_lines(refs), strip), lambda l: F.length(l) > MIN_REF_CHARS
    )


def _peel(x: Column, opening: str, closing: str) -> Column:
    """Drop trailing closers, as many as are unmatched."""

    def count(ch: str) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))

    run = F.length(x) - F.length(F.rtrim(x, F.lit(closing)))
    drop = F.least(run, F.greatest(count(closing) - count(opening), F.lit(0)))
    return F.substr(x, F.lit(1), F.length(x) - drop)


def clean_doi(col: Column) -> Column:
    trimmed = strip(sub(col, TRAILING_JUNK))
    return let(let(trimmed, lambda x: _peel(x, "(", ")")), lambda x: _peel(x, "[", "]"))


def extract_dois(refs: Column, cap: int | None = None) -> Column:
    """Distinct DOIs in discovery order, labelled ones first."""
    found = F.concat(extract_all(refs, DOI_LABELLED), extract_all(refs, DOI_STANDALONE))
    clean = F.filter(F.transform(found, clean_doi), lambda d: d != "")
    return first_n(F.array_distinct(clean), cap)


def link_doi(uri: Column) -> Column:
    """First DOI inside a link target, NULL when there is none."""
    return F.nullif(F.rtrim(extract(uri, DOI_IN_LINK), F.lit(".")), F.lit(""))


def merge_dois(text_dois: Column, link_dois: Column, cap: int | None = None) -> Column:
    return first_n(F.array_union(text_dois, F.coalesce(link_dois, empty_strings())), cap)


def ref_year(line: Column) -> Column:
    return extract(line, YEAR)


def extract_arxiv(refs: Column) -> Column:
    return F.array_distinct(extract_all(refs, ARXIV))


def ref_title(line: Column) -> Column:
    def titled(x: Column) -> Column:
        def long_enough(pattern: str) -> Column:
            t = strip(extract(x, pattern))
            return F.when(F.length(t) > 10, t)

        return F.when(has(x, QUOTED), strip(extract(x, QUOTED))).otherwise(
            F.coalesce(long_enough(AFTER_YEAR_PARENS), long_enough(AFTER_YEAR), F.lit(""))
        )

    return let(strip(sub(line, NUMBERING)), titled)


def citation_label(line: Column, default: Column, ignore_case: bool = False) -> Column:
    label = extract(line, ("(?iu)" if ignore_case else "") + LABEL)
    return F.when(label != "", label).otherwise(default)


def year_number(year: Column) -> Column:
    """A year as a number; the pattern admits digits of any script, only ASCII ones are read."""
    return year.try_cast("int")


def _plausible(years: Column, now: int) -> Column:
    return F.filter(F.transform(years, year_number), lambda y: (y > 1950) & (y <= now))


def years_in(text: Column, now: int) -> Column:
    """All plausible years of a text, in order, as numbers."""
    return _plausible(extract_all(text, YEAR), now)


def year_outside(years: Column, cited: Column) -> Column:
    """Most frequent of ``years``, after those of ``cited`` are taken off, the latest of equals; NULL when none is left."""

    def top(years: Column, cited: Column) -> Column:
        def count(rows: Column, y: Column) -> Column:
            return F.size(F.filter(rows, lambda z: z == y))

        counted = F.transform(
            F.array_distinct(years), lambda y: F.struct((count(years, y) - count(cited, y)).alias("n"), y.alias("y")))
        return F.array_max(F.filter(counted, lambda c: c["n"] > 0))["y"]

    return let(years, lambda y: let(cited, lambda c: top(y, c)))


def paper_year(text: Column, now: int, refs: Column | None = None, window: int | None = None) -> Column:
    """Most frequent year of the text outside its reference block, the latest of equals; NULL when none.

    ``refs`` is the text of the block, which is part of ``text``: its years are taken off the counts, so a long
    bibliography does not outvote the paper's own date. ``window`` restricts the text to its opening characters.
    """
    head = text if window is None else F.substr(text, F.lit(1), F.lit(window))
    cited = F.array().cast("array<int>") if refs is None else years_in(F.coalesce(refs, F.lit("")), now)
    return year_outside(years_in(head, now), cited)


def recency(lines: Column, year: Column, now: int) -> Column:
    """struct<recency_score, recent_ratio, recency_note, ref_years> of a reference list."""
    first_years = F.filter(F.transform(lines, ref_year), lambda y: y != "")

    def of(years: Column) -> Column:
        n = F.size(years)
        recent = F.size(F.filter(years, lambda y: y >= F.coalesce(year, F.lit(now)) - 3))
        ratio = round_exact(recent / n, 2)
        since = F.when(
            year.isNotNull(),
            F.concat(F.lit("last 3 years before paper ("), year.cast("string"), F.lit(")")),
        ).otherwise("last 3 years")
        share = F.concat(recent.cast("string"), F.lit("/"), n.cast("string"),
                         F.lit(" refs from "), since)

        def graded(r: Column) -> Column:
            return F.struct(
                F.when(n == 0, NEUTRAL_SCORE).when(r >= 0.35, 10.0).when(r >= 0.20, 8.0)
                .when(r >= 0.08, 6.0).otherwise(4.0).alias("recency_score"),
                F.when(n > 0, r).alias("recent_ratio"),
                F.when(n == 0, "Could not extract publication years from references.")
                .when(r >= 0.35, F.concat(share, F.lit(" — excellent currency.")))
                .when(r >= 0.20, F.concat(share, F.lit(" — good currency.")))
                .when(r >= 0.08, F.concat(share, F.lit(" — moderate currency.")))
                .otherwise(F.concat(F.lit("Only "), share,
                                    F.lit(" — literature survey may be outdated.")))
                .alias("recency_note"),
                F.sort_array(F.array_distinct(years)).alias("ref_years"),
            )

        return let(F.when(n > 0, ratio), graded)

    return let(_plausible(first_years, now), of)


def duplicate_lines(refs: Column, key_chars: int | None = None) -> Column:
    """Every reference line that, normalised, occurred before (compared by ``key_chars`` characters, if given)."""
    rows = F.transform(
        split_lines(strip(refs)),
        lambda l: F.struct(
            sub(F.lower(strip(l)), uni(r"\s+"), " ").alias("norm"), strip(l).alias("line")
        ),
    )
    long_rows = F.filter(rows, lambda r: F.length(r["norm"]) > MIN_REF_CHARS)
    again = repeats_by_key(
        long_rows, lambda r: r["norm"] if key_chars is None else F.substr(r["norm"], F.lit(1), F.lit(key_chars)))
    return F.transform(again, lambda r: r["line"])


def duplicate_labels(refs: Column, key_chars: int | None = None) -> Column:
    return F.transform(
        duplicate_lines(refs, key_chars),
        lambda l: citation_label(l, F.substr(l, F.lit(1), F.lit(40)), ignore_case=True),
    )


def spread_sample(items: Column, k: int | None) -> Column:
    """All items when at most ``k`` (or without a limit), else ``k`` spread evenly over the array."""
    if k is None:
        return items
    n = F.size(items)
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: items[F.floor(i * n / k).cast("int")],
    )
    return F.when(n <= k, items).otherwise(picks)
