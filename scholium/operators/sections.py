"""Line, heading and section operators. Every one but the map lookup is a narrow projection.

``bundled`` frames hold all eight sections of a document in one array column
(``sections: array<struct<section, text, by_hash>>``), so later stages need no regrouping;
``long_sections`` gives the one-row-per-section form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.constants import (
    FALLBACK_SCAN_MAX_SECTIONS, REQUIRED_SECTIONS, SECTION_KEYS, TIER2_MIN_SECTIONS,
    VALID_MAP_KEYS,
)
from scholium.functions import headings as H
from scholium.functions import sections as S
from scholium.functions.text import first_n, is_upper, split_lines, strip
from scholium.operators.frames import pin
from scholium.operators.lookup import lookup_join


def explode_lines(papers: DataFrame) -> DataFrame:
    return papers.select(
        "doc_id", F.posexplode_outer(split_lines(F.col("text"))).alias("line_no", "line")
    ).where(F.col("line_no").isNotNull())


def line_events(lines: DataFrame) -> DataFrame:
    """Adds heading test, cleaned heading, event kind and opened section to each line."""
    out = lines.withColumn("is_heading", H.is_heading(F.col("line")))
    out = out.withColumn("clean", F.when(F.col("is_heading"), H.clean_heading(F.col("line"))))
    code = H.line_code(F.col("line"))
    out = out.withColumn("code", code)
    names = F.create_map(*[F.lit(x) for k, c in H.SECTION_CODE.items() for x in (c, k)])
    return out.select(
        "doc_id", "line_no", "line", "is_heading", "clean",
        F.when(F.col("code") == H.HARD_STOP, "HARD_CLEAR")
        .when(F.col("code") == H.SOFT_STOP, "SOFT_CLEAR")
        .when(F.col("code") != H.PLAIN, "SET").alias("event"),
        F.try_element_at(names, F.col("code")).alias("section"),
    )


def keyword_sections(papers: DataFrame) -> DataFrame:
    """Keyword segmentation alone, bundled."""
    runs = pin(papers, runs=S.section_runs(F.col("text")))
    return pin(runs, sections=S.keyword_sections(F.col("runs"))).drop("runs")


def fallback_scan(bundled: DataFrame) -> DataFrame:
    """Scan the raw text for the empty sections of documents with few sections."""
    few = S.found_count(F.col("sections")) <= FALLBACK_SCAN_MAX_SECTIONS
    return pin(
        bundled,
        sections=F.when(few, S.scan_missing(F.col("text"), F.col("sections")))
        .otherwise(F.col("sections")),
    )


def segment_sections(papers: DataFrame) -> DataFrame:
    """Keyword segmentation and fallback scan, bundled, with ``tier`` = 1."""
    return fallback_scan(keyword_sections(papers)).withColumn("tier", F.lit(1))


def long_sections(bundled: DataFrame) -> DataFrame:
    """Non-empty sections, one row each; ``ord`` is the section's place in the fixed order."""
    keep = [c for c in bundled.columns if c not in ("sections", "text")]
    return (
        bundled.select(*keep, F.posexplode_outer("sections").alias("ord", "s"))
        .where(F.col("s.text") != "")
        .select(*keep, "ord", F.col("s.section").alias("section"),
                F.col("s.text").alias("text"), F.col("s.by_hash").alias("by_hash"))
    )


def candidate_headings(papers: DataFrame) -> DataFrame:
    return papers.select(
        "doc_id", F.posexplode_outer(S.candidate_headings(F.col("text"))).alias("pos", "heading")
    ).where(F.col("pos").isNotNull())


def map_headings(headings: DataFrame, heading_map: DataFrame) -> DataFrame:
    """Per document the mapped candidate headings, in document order: (doc_id, mapping).

    Only short heading strings are shuffled.
    """
    valid = (
        heading_map.where(F.col("section").isin(VALID_MAP_KEYS))
        .groupBy("heading").agg(F.max("section").alias("section"))
    )
    found = lookup_join(headings, valid, "heading", how="inner")
    entry = F.struct("pos", H.clean_heading(F.col("heading")).alias("clean"), "section")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("mapping"))


def with_mapping(papers: DataFrame, mapping: DataFrame, how: str) -> DataFrame:
    """Papers with their ``mapping``; the slim side is hashed, so papers are neither sorted nor, if bucketed by id, moved."""
    return papers.join(mapping.hint("shuffle_hash"), "doc_id", how)


def segment_by_map(papers: DataFrame, heading_map: DataFrame, cut=None) -> DataFrame:
    """Segmentation by the heading map; documents without a mapped heading have no sections.

    ``cut`` may write the papers as a table bucketed by ``doc_id``; no text is shuffled then. It also writes their
    candidate headings, which are read several times.
    """
    cut = cut or (lambda df: df)
    papers = cut(papers)
    mapped = with_mapping(papers, map_headings(cut(candidate_headings(papers)), heading_map), "inner")
    return pin(mapped, sections=S.map_sections(F.col("text"), F.col("mapping"))).drop("mapping")


def lay_map_over(sparse: DataFrame) -> DataFrame:
    """Sparse keyword results with a ``mapping`` column (NULL without one): the map's sections laid over them."""
    over = F.when(
        F.col("mapping").isNotNull(),
        S.merge_sections(F.col("sections"), S.map_sections(F.col("text"), F.col("mapping"))),
    )
    out = pin(sparse, m=over)
    keep = [c for c in sparse.columns if c not in ("sections", "tier", "mapping")]
    return out.select(
        *keep,
        F.coalesce("m.sections", "sections").alias("sections"),
        F.coalesce("m.tier", F.lit(1)).alias("tier"),
    )


def detect_sections(papers: DataFrame, heading_map: DataFrame | None = None, cut=None, keep_text: bool = True) -> DataFrame:
    """Two-tier detection.

    Headings of sparse documents are looked up as short strings; their mapping comes back to the text in
    one join, in which dense documents take no part. ``cut`` may materialise the keyword result, which is
    read three times: as a table bucketed by ``doc_id`` (:class:`scholium.sources.shared.Bucketed`), texts and sections stay where
    they are. Without ``keep_text`` the result has no ``text``, and that of dense documents is not even written.
    """
    tier1 = segment_sections(papers)
    if heading_map is None:
        return tier1 if keep_text else tier1.drop("text")
    tier1 = tier1.withColumn("sparse", S.found_count(F.col("sections")) < TIER2_MIN_SECTIONS)
    if not keep_text:
        tier1 = tier1.withColumn("text", F.when(F.col("sparse"), F.col("text")))
    if cut is not None:
        tier1 = cut(tier1)
    few = tier1.where("sparse").drop("sparse")
    mapping = map_headings(candidate_headings(few.select("doc_id", "text")), heading_map)
    laid = lay_map_over(with_mapping(few, mapping, "left"))
    out = tier1.where(~F.col("sparse")).drop("sparse").unionByName(laid)
    return out if keep_text else out.drop("text")


def with_confidence(bundled: DataFrame) -> DataFrame:
    """Adds ``detected``: array<struct<section, confidence>> of the non-empty sections."""
    present = F.filter("sections", lambda s: s["text"] != "")
    return bundled.withColumn(
        "detected",
        F.transform(
            present,
            lambda s: F.struct(
                s["section"].alias("section"),
                S.confidence(s["text"], s["by_hash"], F.col("tier")).alias("confidence"),
            ),
        ),
    )


def section_confidence(sections: DataFrame) -> DataFrame:
    """Confidence per row of a long sections frame (needs text, by_hash, tier)."""
    return sections.withColumn(
        "confidence", S.confidence(F.col("text"), F.col("by_hash"), F.col("tier"))
    )


def warning_list(sections: Column) -> Column:
    missing = [
        F.when(sections[SECTION_KEYS.index(k)]["text"] == "", F.lit(k)) for k in REQUIRED_SECTIONS
    ]
    return F.filter(F.array(*missing), lambda x: x.isNotNull())


def section_warnings(bundled: DataFrame) -> DataFrame:
    return bundled.select(
        "doc_id",
        warning_list(F.col("sections")).alias("warnings"),
        S.found_count(F.col("sections")).alias("section_count"),
    )


def section_profile(bundled: DataFrame) -> DataFrame:
    """Characters per section, one column each; a section is found when the count is positive."""
    return bundled.select(
        "doc_id",
        *[F.length(F.col("sections")[i]["text"]).alias(k) for i, k in enumerate(SECTION_KEYS)],
    )


def heading_profile(papers: DataFrame, n: int | None = None) -> DataFrame:
    """Heading-like lines with line numbers, the first ``n`` of each document if given, and how many."""

    def candidate(line: Column) -> Column:
        size = F.length(line)
        return (size > 0) & (size <= 80) & (
            line.startswith("#")
            | (is_upper(line) & (size >= 3))
            | F.regexp_like(line, F.lit(H.NUMBERED_HEADING))
            | ((size < 80) & ~line.endswith(".") & ~line.startswith("|"))
        )

    numbered = F.transform(
        split_lines(F.col("text")),
        lambda l, i: F.struct(i.alias("line_no"), strip(l).alias("heading")),
    )
    found = pin(
        papers.select("doc_id", "text"),
        found=F.filter(numbered, lambda x: candidate(x["heading"])),
    )
    return found.select(
        "doc_id",
        F.size("found").alias("total"),
        F.explode_outer(first_n(F.col("found"), n)).alias("h"),
    ).where(F.col("total") > 0).select("doc_id", "h.line_no", "h.heading", "total")


def compare_extractions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where each of the eight sections was found: in both, only a, only b, or neither."""

    def found(df: DataFrame, name: str) -> DataFrame:
        keys = F.transform(F.filter("sections", lambda s: s["text"] != ""), lambda s: s["section"])
        return df.select("doc_id", keys.alias(name))

    both = found(a, "in_a").join(found(b, "in_b"), "doc_id", "full_outer")
    rows = both.select(
        "doc_id", "in_a", "in_b",
        F.explode(F.array(*[F.lit(k) for k in SECTION_KEYS])).alias("section"),
    )
    in_a = F.coalesce(F.array_contains("in_a", F.col("section")), F.lit(False))
    in_b = F.coalesce(F.array_contains("in_b", F.col("section")), F.lit(False))
    return rows.select(
        "doc_id", "section",
        F.when(in_a & in_b, "both").when(in_a, "a_only").when(in_b, "b_only")
        .otherwise("neither").alias("outcome"),
    )
