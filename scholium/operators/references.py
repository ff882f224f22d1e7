"""Reference extraction over documents; all narrow. Input: ``refs(doc_id, refs)`` unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.constants import DUPLICATE_DETAIL, SECTION_KEYS
from scholium.functions import references as RF
from scholium.functions.text import empty_strings, strip
from scholium.operators.frames import pin


def references_of(bundled: DataFrame) -> DataFrame:
    """(doc_id, text, refs) of a bundled frame."""
    return bundled.select(
        "doc_id", "text", F.col("sections")[SECTION_KEYS.index("references")]["text"].alias("refs")
    )


def _rows(df: DataFrame, items: Column, name: str) -> DataFrame:
    pinned = pin(df.select("doc_id", "refs"), items=items)
    return pinned.select(
        "doc_id", F.posexplode_outer("items").alias("pos", name)
    ).where(F.col("pos").isNotNull())


def ref_lines(refs: DataFrame) -> DataFrame:
    return _rows(refs, RF.ref_lines(F.col("refs")), "line")


def ref_counts(refs: DataFrame) -> DataFrame:
    return refs.select("doc_id", total_refs(F.col("refs")).alias("total_refs"))


def total_refs(refs: Column) -> Column:
    return F.when(strip(refs) == "", 0).otherwise(
        F.greatest(F.size(RF.ref_lines(refs)), F.lit(1))
    )


def extract_dois(refs: DataFrame, cap: int | None = None) -> DataFrame:
    return _rows(refs, RF.extract_dois(F.col("refs"), cap), "doi")


def extract_arxiv(refs: DataFrame) -> DataFrame:
    return _rows(refs, RF.extract_arxiv(F.col("refs")), "arxiv_id")


def merge_dois(text_dois: DataFrame, link_dois: DataFrame, cap: int | None = None) -> DataFrame:
    """Both inputs (doc_id, dois ARRAY); text order first."""
    links = link_dois.select("doc_id", F.col("dois").alias("links"))
    return text_dois.join(links, "doc_id", "left").select(
        "doc_id", RF.merge_dois(F.col("dois"), F.col("links"), cap).alias("dois")
    )


def ref_titles(refs: DataFrame) -> DataFrame:
    lines = ref_lines(refs)
    return lines.select(
        "doc_id", "pos", RF.ref_title(F.col("line")).alias("title"),
        RF.ref_year(F.col("line")).alias("year"),
    )


def with_links(docs: DataFrame, link_dois: DataFrame) -> DataFrame:
    """Documents with the DOIs of their links (doc_id, dois ARRAY) as ``links``.

    What is asked of reference lines afterwards is costly for their few bytes, so partitions must not be merged by size.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = link_dois.select("doc_id", F.col("dois").alias("links"))
    return docs.repartition(parts, "doc_id").join(links, "doc_id", "left")


def paper_year(refs: DataFrame, now: int) -> DataFrame:
    """Needs text and refs: only years outside the reference block count."""
    return refs.select("doc_id", RF.paper_year(F.col("text"), now, F.col("refs")).alias("year"))


def recency(refs: DataFrame, now: int) -> DataFrame:
    """Needs text and refs; adds the recency fields."""
    out = pin(refs, year=RF.paper_year(F.col("text"), now, F.col("refs")))
    out = pin(out, recency=RF.recency(RF.ref_lines(F.col("refs")), F.col("year"), now))
    return out.select("doc_id", "year", "recency.*")


def duplicate_refs(refs: DataFrame) -> DataFrame:
    rows = _rows(refs, RF.duplicate_labels(F.col("refs")), "citation")
    return rows.select(
        "doc_id", "pos", "citation", F.lit("duplicate").alias("category"),
        F.lit(DUPLICATE_DETAIL).alias("detail"),
    )


def reference_facts(docs: DataFrame, now: int, keep: list[str] | None = None) -> DataFrame:
    """Everything the citation score needs from the text, per document.

    Input (doc_id, refs, links ARRAY) and either text or its paper_year. Reference lines are reduced to what later stages
    ask of them (title, year, which DOIs they contain), so no reference text is shuffled.
    """
    base = pin(
        docs,
        lines=RF.ref_lines(F.col("refs")),
        dois=F.when(strip(F.col("refs")) == "", empty_strings()).otherwise(
            RF.merge_dois(RF.extract_dois(F.col("refs")), F.col("links"))
        ),
        arxiv_ids=RF.extract_arxiv(F.col("refs")),
        paper_year=F.col("paper_year") if "paper_year" in docs.columns else RF.paper_year(F.col("text"), now, F.col("refs")),
        duplicates=RF.duplicate_labels(F.col("refs")),
    )

    def item(line: Column, pos: Column) -> Column:
        inside = F.filter(
            F.transform(F.col("dois"), lambda d, i: F.when(F.contains(line, d), i)),
            lambda i: i.isNotNull(),
        )
        return F.struct(
            pos.alias("pos"), RF.ref_title(line).alias("title"), RF.ref_year(line).alias("year"),
            inside.alias("doi_hits"),
        )

    def doi_label(doi: Column) -> Column:
        first = F.filter("lines", lambda l: F.contains(l, doi))
        return F.coalesce(
            F.get(
                F.transform(F.slice(first, 1, 1), lambda l: RF.citation_label(l, doi)), F.lit(0)
            ),
            doi,
        )

    return pin(
        base,
        blank=strip(F.col("refs")) == "",
        total_refs=F.when(strip(F.col("refs")) == "", 0)
        .otherwise(F.greatest(F.size("lines"), F.lit(1))),
        items=F.transform("lines", item),
        doi_labels=F.transform("dois", doi_label),
        recency=RF.recency(F.col("lines"), F.col("paper_year"), now),
    ).select(
        "doc_id", "blank", "total_refs", "dois", "doi_labels", "arxiv_ids", "items",
        "duplicates", "recency", *(keep or []),
    )
