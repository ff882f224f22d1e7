"""Whole-corpus jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.constants import DISPLAY_NAME, EMPTY_ISSUE, EMPTY_SUGGESTION, LAYERS, MODEL_LAYERS, SECTION_KEYS
from scholium.functions import references as RF
from scholium.functions import scoring as SC
from scholium.operators import compression as COMP
from scholium.operators import prompts as PR
from scholium.operators import references as REF
from scholium.operators import reviews as RV
from scholium.operators import sections as SEC
from scholium.operators import validation as VAL
from scholium.operators import verification as V
from scholium.operators.lookup import lookup_join
from scholium.sources.readers import accept_papers, link_dois
from scholium.sources.shared import Bucketed, give_back, materialize


def prepare_corpus(
    papers: DataFrame, links: DataFrame | None, heading_map: DataFrame | None, now: int,
    mode: str = "light", cut=materialize,
) -> tuple[DataFrame, DataFrame]:
    """(facts, prompts) of the usable papers, one slim row per paper in each.

    Sections are written once, bucketed by document, so that no text is shuffled; that table goes as soon as prompt,
    content key, reference block and year are taken from it. Links are joined to what is left of the reference block. Papers with
    too little text are rejected (:func:`scholium.sources.readers.accept_papers`).
    """
    papers, _ = accept_papers(papers)
    papers = papers.withColumn("years", RF.years_in(F.col("text"), now))
    tables = Bucketed(papers.sparkSession)
    docs = SEC.with_confidence(SEC.detect_sections(papers, heading_map, tables, keep_text=False))
    docs = PR.assemble_prompt(COMP.compressed_texts(docs, mode)).drop("texts")
    refs = F.col("sections")[SECTION_KEYS.index("references")]["text"]
    slim = cut(docs.select(
        "doc_id", "prompt", "content_key", "content_digest", "detected", "tier",
        SEC.warning_list(F.col("sections")).alias("warnings"),
        refs.alias("refs"), RF.year_outside(F.col("years"), RF.years_in(refs, now)).alias("paper_year"),
        (F.col("prompt") == "").alias("empty"),
    ))
    tables.remove()
    give_back(papers.sparkSession)  # no plan of the job is longer
    prompts = slim.select("doc_id", "content_digest", "prompt")
    rows = slim.drop("prompt")
    if links is not None:
        rows = REF.with_links(rows, link_dois(links))
    else:
        rows = rows.withColumn("links", F.array().cast("array<string>"))
    keep = ["content_key", "content_digest", "detected", "warnings", "tier", "empty"]
    return cut(REF.reference_facts(rows, now, keep=keep)), prompts


def with_stored(facts: DataFrame, reviews: DataFrame, store: DataFrame | None) -> DataFrame:
    """(doc_id, review_json) of every paper that has a review, stored ones by content before new ones.

    ``store`` is (content_digest, review_json), unique by digest, of earlier successful reviews.
    """
    if store is None:
        return reviews.select("doc_id", "review_json")
    known = lookup_join(
        facts.select("doc_id", "content_digest"), store.select("content_digest", F.col("review_json").alias("stored")), "content_digest")
    return known.join(reviews.select("doc_id", "review_json"), "doc_id", "left").select(
        "doc_id", F.coalesce("stored", "review_json").alias("review_json")).where(F.col("review_json").isNotNull())


def analyze_prepared(
    facts: DataFrame, reviews: DataFrame, works: DataFrame, preprints: DataFrame,
    log: DataFrame | None = None, dice: bool = False, cut=materialize, store: DataFrame | None = None,
) -> DataFrame:
    """Result record per prepared paper; reviews are keyed by doc_id, stored ones by content.

    A paper without any review gets the fallback review and ``analysis_failed``.
    """
    kept = ["content_key", "content_digest", "detected", "warnings", "tier", "empty"]
    citations = cut(V.check_citations(facts.drop(*kept), works, preprints, log, dice, cut))
    parsed = RV.parse_reviews(with_stored(facts, reviews, store))
    docs = facts.select("doc_id", *kept).join(parsed, "doc_id", "left")
    nothing = F.array(*[
        RV._layer(n, F.lit(0.0), RV._one(EMPTY_ISSUE), RV._one(EMPTY_SUGGESTION)) for n in MODEL_LAYERS
    ])
    missing = F.col("layers").isNull() & ~F.col("empty")
    docs = docs.withColumn("analysis_failed", F.coalesce("analysis_failed", missing)).withColumn(
        "layers", F.when(F.col("empty"), nothing).otherwise(F.coalesce("layers", RV.fallback_layers()))
    ).withColumn("discipline", SC.resolve_discipline(F.col("discipline")))
    layered = RV.add_citations_layer(RV.calibrate(docs), citations)
    scored = RV.verdict(RV.weighted_score(layered))
    return analysis_record(scored, citations)


def analysis_record(scored: DataFrame, citations: DataFrame) -> DataFrame:
    """The nested result record of each paper."""
    cites = citations.select(
        "doc_id",
        F.struct("total_refs", "verified", "not_found", "unreachable", "flagged_dois", "flagged_items")
        .alias("citation_result"),
    )
    shown = F.transform(
        "detected",
        lambda d: F.struct(SC.lookup(DISPLAY_NAME, d["section"]).alias("k"), d["confidence"].alias("v")),
    )
    details = F.transform(
        "layers",
        lambda x: F.struct(x["layer"].alias("k"), F.struct(
            x["raw"].alias("score"), x["issues"].alias("issues"),
            x["suggestions"].alias("suggestions")).alias("v")),
    )
    marks = F.create_map(*[
        x for l in LAYERS for x in (F.lit(l), SC.max_mark(F.col("discipline"), F.lit(l)))])
    return scored.join(cites, "doc_id").select(
        "doc_id", "content_key", "content_digest", "analysis_failed",
        F.map_from_entries(shown).alias("detected_sections"),
        F.size("detected").alias("section_count"),
        "warnings",
        F.col("scores").alias("layer_scores"),
        F.map_from_entries(details).alias("layer_details"),
        "final_score", "grade", "discipline",
        marks.alias("layer_max_marks"),
        "verdict_text", "citation_result",
    )


def analyze_corpus(
    papers: DataFrame, links: DataFrame | None, heading_map: DataFrame | None, reviews: DataFrame,
    works: DataFrame, preprints: DataFrame, now: int, log: DataFrame | None = None,
    mode: str = "light", dice: bool = False, cut=materialize, store: DataFrame | None = None,
) -> DataFrame:
    """Analyse a corpus: text stage, verification, scoring, one record per usable paper."""
    facts, _ = prepare_corpus(papers, links, heading_map, now, mode, cut)
    return analyze_prepared(facts, reviews, works, preprints, log, dice, cut, store)


def validate_batch(results: DataFrame, meta: DataFrame) -> dict[str, DataFrame]:
    """Validation records, findings, summary, verdict and run counts of a batch."""
    validations = VAL.validate(results, meta)
    summary = VAL.run_summary(validations)
    return {
        "validations": validations,
        "findings": VAL.findings(validations),
        "summary": summary,
        "verdict": VAL.run_verdict(summary),
        "counts": VAL.batch_counts(results),
    }
