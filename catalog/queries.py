
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.functions import compression as CF
from scholium.functions import headings as H
from scholium.constants import LAYERS
from scholium.functions import prompts as PF
from scholium.functions import references as RF
from scholium.functions import scoring as SC
from scholium.functions import sections as SECF
from scholium.operators import compression as COMP
from scholium.operators import prompts as PR
from scholium.operators import references as REF
from scholium.operators import reviews as RV
from scholium.operators import validation as VAL
from scholium.operators import verification as V
from scholium.plans import analyze as PLAN
from scholium.sources import incremental as INC
from scholium.operators import sections as SEC
from scholium.sources import derived
from scholium.sources import readers
from scholium.sources.readers import spread
from scholium.sources.shared import Bucketed, materialize, new_path
from scholium.streaming import analyze_stream as STREAM

NOW = 2024  # "current year" of the registered queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register a query; integer columns are widened so both engines report BIGINT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(
            *[
                F.col(f.name).cast("bigint") if isinstance(f.dataType, T.IntegerType) else F.col(f.name)
                for f in df.schema.fields
            ]
        )

    QUERIES[fn.__name__] = run
    return run


def documents(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


def papers(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.papers_sql, spread_key="doc_id")


def heading_map(spark, sf_dir):
    return spark.sql(derived.heading_map_sql(derived.SPARK))


def bundled(spark, sf_dir):
    return SEC.segment_sections(papers(spark, sf_dir))


def detected(spark, sf_dir):
    return SEC.detect_sections(papers(spark, sf_dir), heading_map(spark, sf_dir), cut=Bucketed(spark), keep_text=False)


# --- lines, headings, sections ---------------------------------------------

@query
def l1_explode_lines(spark, sf_dir):
    return SEC.explode_lines(papers(spark, sf_dir))


@query
def l1_explode_lines_raw(spark, sf_dir):
    return SEC.explode_lines(documents(spark, sf_dir))


@query
def l2_clean_heading(spark, sf_dir):
    lines = SEC.explode_lines(papers(spark, sf_dir))
    return lines.select("doc_id", "line_no", H.clean_heading(F.col("line")).alias("clean"))


@query
def l3_is_heading(spark, sf_dir):
    lines = SEC.explode_lines(papers(spark, sf_dir))
    return lines.where(H.is_heading(F.col("line"))).select("doc_id", "line_no", "line")


@query
def l3_is_heading_raw(spark, sf_dir):
    lines = SEC.explode_lines(documents(spark, sf_dir))
    return lines.where(H.is_heading(F.col("line"))).select("doc_id", "line_no", "line")


@query
def l4_line_events(spark, sf_dir):
    ev = SEC.line_events(SEC.explode_lines(papers(spark, sf_dir)))
    return ev.where(F.col("event").isNotNull()).select("doc_id", "line_no", "event", "section")


@query
def l5_classify_heading(spark, sf_dir):
    lines = SEC.explode_lines(papers(spark, sf_dir))
    clean = lines.where(H.is_heading(F.col("line"))).select(H.clean_heading(F.col("line")).alias("clean"))
    hits = clean.withColumn("section", H.classify_heading(F.col("clean")))
    return hits.groupBy("clean", "section").agg(F.count(F.lit(1)).alias("n"))


@query
def l6_segment_sections(spark, sf_dir):
    rows = SEC.long_sections(SEC.keyword_sections(papers(spark, sf_dir)))
    return rows.select("doc_id", "section", "text", "by_hash")


@query
def l7_fallback_scan(spark, sf_dir):
    rows = SEC.long_sections(bundled(spark, sf_dir))
    return rows.select("doc_id", "section", "text", "by_hash")


@query
def l8_candidate_headings(spark, sf_dir):
    return SEC.candidate_headings(papers(spark, sf_dir))


@query
def l9_segment_by_map(spark, sf_dir):
    out = SEC.segment_by_map(papers(spark, sf_dir), heading_map(spark, sf_dir), cut=Bucketed(spark))
    return SEC.long_sections(out).select("doc_id", "section", "text")


@query
def l10_merge_tiers(spark, sf_dir):
    rows = SEC.long_sections(detected(spark, sf_dir))
    return rows.select("doc_id", "section", "text", "tier")


@query
def l11_section_confidence(spark, sf_dir):
    rows = SEC.section_confidence(SEC.long_sections(detected(spark, sf_dir)))
    return rows.select("doc_id", "section", "confidence")


@query
def l12_section_warnings(spark, sf_dir):
    w = SEC.section_warnings(detected(spark, sf_dir))
    return w.select("doc_id", F.array_join("warnings", ",").alias("warnings"), "section_count")


@query
def l13_section_profile(spark, sf_dir):
    return SEC.section_profile(bundled(spark, sf_dir))


@query
def l14_heading_profile(spark, sf_dir):
    return SEC.heading_profile(documents(spark, sf_dir))


@query
def l15_compare_extractions(spark, sf_dir):
    p = papers(spark, sf_dir)
    return SEC.compare_extractions(
        SEC.keyword_sections(p), SEC.segment_by_map(p, heading_map(spark, sf_dir), cut=Bucketed(spark)))


def long_detected(spark, sf_dir):
    return SEC.long_sections(detected(spark, sf_dir)).select("doc_id", "section", "text")


def compressed(spark, sf_dir):
    return COMP.compress_sections(long_detected(spark, sf_dir))


def with_texts(spark, sf_dir):
    return COMP.compressed_texts(detected(spark, sf_dir))


# --- compression -------------------------------------------------------------

@query
def c1_normalize_ws(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", CF.normalize_ws(F.col("text")).alias("out"))


@query
def c2_mask_urls(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", CF.mask_urls(F.col("text")).alias("out"))


@query
def c2_mask_urls_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", CF.mask_urls(F.concat_ws(" ", "url", "html")).alias("out"))


@query
def c3_strip_citations(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", CF.strip_citations(F.col("text")).alias("out"))


@query
def c4_strip_boilerplate(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "doc_id", CF.strip_boilerplate(F.col("text"), evidence=False).alias("out"))


@query
def c5_strip_boilerplate_evidence(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "doc_id", CF.strip_boilerplate(F.col("text"), evidence=True).alias("out"))


@query
def c6_dedup_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", CF.dedup_sentences(F.col("text")).alias("out"))


@query
def c7_drop_formula_lines(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "doc_id", CF.drop_formula_lines(F.col("text")).alias("light"),
        CF.drop_formula_lines(F.col("text"), aggressive=True).alias("aggressive"))


@query
def c8_compress_sections(spark, sf_dir):
    return compressed(spark, sf_dir).select("doc_id", "section", "compressed")


@query
def c8_compress_sections_aggressive(spark, sf_dir):
    """Sections with a name of their own are cut hardest in this mode; related work stands for such a one."""
    named = F.when(F.col("section") == "related_work", "survey").otherwise(F.col("section"))
    out = COMP.compress_sections(long_detected(spark, sf_dir).withColumn("section", named), "aggressive")
    return out.select("doc_id", "section", "compressed")


@query
def c8_compress_sections_off(spark, sf_dir):
    return COMP.compress_sections(long_detected(spark, sf_dir), "off").select("doc_id", "section", "compressed")


@query
def c9_compression_stats(spark, sf_dir):
    return COMP.compression_stats(compressed(spark, sf_dir))


@query
def c10_compression_report(spark, sf_dir):
    return COMP.compression_report(COMP.compression_stats(compressed(spark, sf_dir)))


# --- prompts -----------------------------------------------------------------

@query
def p1_captions(spark, sf_dir):
    return PR.captions(with_texts(spark, sf_dir))


@query
def p2_smart_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", PF.smart_truncate(F.col("text"), 700).alias("cut_700"),
        PF.smart_truncate(F.col("text"), 40).alias("cut_40"))


@query
def p3_assemble_prompt(spark, sf_dir):
    return PR.assemble_prompt(with_texts(spark, sf_dir)).select("doc_id", "prompt")


@query
def p4_token_budget(spark, sf_dir):
    return PR.token_budget(long_detected(spark, sf_dir))


@query
def s8_content_key(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select(
        "doc_id", PF.content_key(F.col("text")).alias("content_key"),
        PF.heading_list_key(SECF.candidate_headings(F.col("text"))).alias("heading_key"))


# --- references --------------------------------------------------------------

def refs(spark, sf_dir):
    return REF.references_of(bundled(spark, sf_dir))


def works(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.works_sql)


def preprints(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.preprints_sql)


def lookup_log(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.lookup_log_sql)


def links(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.links_sql)


def facts(spark, sf_dir):
    year = RF.paper_year(F.col("text"), NOW, F.col("refs"))
    slim = refs(spark, sf_dir).select("doc_id", "refs", year.alias("paper_year"))
    return REF.reference_facts(REF.with_links(slim, readers.link_dois(links(spark, sf_dir))), NOW)


def stored_facts(spark, sf_dir):
    return materialize(facts(spark, sf_dir))


@query
def s2_link_dois(spark, sf_dir):
    out = readers.link_dois(links(spark, sf_dir))
    return out.select("doc_id", F.array_join("dois", "|").alias("dois"))


@query
def s2_hrefs(spark, sf_dir):
    return readers.hrefs(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def k1_ref_lines(spark, sf_dir):
    return REF.ref_lines(refs(spark, sf_dir))


@query
def k1_total_refs(spark, sf_dir):
    return REF.ref_counts(refs(spark, sf_dir))


@query
def k2_extract_dois(spark, sf_dir):
    return REF.extract_dois(refs(spark, sf_dir))


@query
def k3_merge_dois(spark, sf_dir):
    text = refs(spark, sf_dir).select("doc_id", RF.extract_dois(F.col("refs")).alias("dois"))
    merged = REF.merge_dois(text, readers.link_dois(links(spark, sf_dir)))
    return merged.select("doc_id", F.array_join("dois", "|").alias("dois"))


@query
def k4_ref_year(spark, sf_dir):
    lines = REF.ref_lines(refs(spark, sf_dir))
    return lines.select("doc_id", "pos", RF.ref_year(F.col("line")).alias("year"))


@query
def k5_extract_arxiv(spark, sf_dir):
    return REF.extract_arxiv(refs(spark, sf_dir))


@query
def k6_ref_title(spark, sf_dir):
    return REF.ref_titles(refs(spark, sf_dir)).select("doc_id", "pos", "title")


@query
def k7_paper_year(spark, sf_dir):
    return REF.paper_year(refs(spark, sf_dir), NOW)


@query
def k8_recency(spark, sf_dir):
    r = REF.recency(refs(spark, sf_dir), NOW)
    return r.withColumn("ref_years", F.array_join(F.col("ref_years").cast("array<string>"), ","))


@query
def k9_duplicate_refs(spark, sf_dir):
    return REF.duplicate_refs(refs(spark, sf_dir))


@query
def k9_duplicate_lines_raw(spark, sf_dir):
    d = documents(spark, sf_dir).withColumnRenamed("text", "refs")
    return REF.duplicate_refs(d).select("doc_id", "pos", "citation")


@query
def k10_citation_label(spark, sf_dir):
    lines = REF.ref_lines(refs(spark, sf_dir))
    return lines.select(
        "doc_id", "pos", RF.citation_label(F.col("line"), F.lit("none")).alias("exact"),
        RF.citation_label(F.col("line"), F.substr("line", F.lit(1), F.lit(40)), True).alias("loose"))


# --- verification --------------------------------------------------------------

def title_checks(spark, sf_dir):
    return materialize(REF.ref_titles(refs(spark, sf_dir)))


def id_status(spark, sf_dir, **limits):
    known = V.registry(works(spark, sf_dir), preprints(spark, sf_dir))
    return V.with_id_status(stored_facts(spark, sf_dir), known, lookup_log(spark, sf_dir), **limits)


def counted(spark, sf_dir):
    status = materialize(id_status(spark, sf_dir))
    titles = V.verify_titles(V.title_checks(status), works(spark, sf_dir), lookup_log(spark, sf_dir), cut=materialize)
    return V.outcome_counts(status, titles)


def citations(spark, sf_dir):
    return V.check_citations(
        stored_facts(spark, sf_dir), works(spark, sf_dir), preprints(spark, sf_dir),
        lookup_log(spark, sf_dir), cut=materialize)


@query
def v1_lookup_status(spark, sf_dir):
    return V.lookup_status(lookup_log(spark, sf_dir))


@query
def v2_verify_dois(spark, sf_dir):
    dois = materialize(REF.extract_dois(refs(spark, sf_dir)))
    return V.verify_dois(dois, works(spark, sf_dir), lookup_log(spark, sf_dir))


@query
def v3_verify_arxiv(spark, sf_dir):
    ids = materialize(REF.extract_arxiv(refs(spark, sf_dir)))
    return V.verify_arxiv(ids, preprints(spark, sf_dir), lookup_log(spark, sf_dir))


@query
def v4_search_titles(spark, sf_dir):
    found = V.search_titles(title_checks(spark, sf_dir), works(spark, sf_dir), cut=materialize)
    return found.select("title", "found", "shared")


@query
def v4_verify_titles(spark, sf_dir):
    return V.verify_titles(
        title_checks(spark, sf_dir), works(spark, sf_dir), lookup_log(spark, sf_dir),
        cut=materialize)


@query
def v4_verify_titles_dice(spark, sf_dir):
    return V.verify_titles(
        title_checks(spark, sf_dir), works(spark, sf_dir), lookup_log(spark, sf_dir), dice=True,
        cut=materialize)


@query
def v5_uncovered_refs(spark, sf_dir):
    """References with a title and without a verified DOI: all that are looked up by title."""
    return V.title_checks(id_status(spark, sf_dir))


@query
def v6_sample_refs(spark, sf_dir):
    """The sample that a caller with a limited look-up service may ask for."""
    return V.title_checks(id_status(spark, sf_dir, sample=5, first=10))


@query
def v7_outcome_counts(spark, sf_dir):
    return counted(spark, sf_dir).select(
        "doc_id", F.col("verified").cast("bigint"), F.col("not_found").cast("bigint"),
        F.col("unreachable").cast("bigint"), F.col("t_checked").alias("checked_titles"))


@query
def v8_citation_score(spark, sf_dir):
    """Scores of papers with DOIs (V8), without (V9) and without references (V10)."""
    return citations(spark, sf_dir).select(
        "doc_id", "score", "total_refs", "verified", "not_found", "unreachable", "arxiv_verified")


@query
def v9_citation_score_no_doi(spark, sf_dir):
    c = counted(spark, sf_dir).where((F.size("dois") == 0) & ~F.col("blank"))
    return c.select("doc_id", V.score_without_dois().alias("score"))


@query
def v10_blank_references(spark, sf_dir):
    blank = facts(spark, sf_dir).where(F.col("blank"))
    return blank.select("doc_id", F.lit(0.0).alias("score"), "total_refs")


@query
def v11_flagged_items(spark, sf_dir):
    rows = citations(spark, sf_dir).select("doc_id", F.posexplode_outer("flagged_items").alias("pos", "f"))
    return rows.where(F.col("pos").isNotNull()).select("doc_id", "pos", "f.citation", "f.category", "f.detail")


@query
def v12_citation_messages(spark, sf_dir):
    return citations(spark, sf_dir).select(
        "doc_id", F.array_join("issues", "|").alias("issues"),
        F.array_join("suggestions", "|").alias("suggestions"))


@query
def v13_citation_summary(spark, sf_dir):
    return V.citation_summary(citations(spark, sf_dir))


# --- sources and incremental analysis ------------------------------------------

@query
def s1_load_papers(spark, sf_dir):
    accepted, rejected = readers.load_papers(spark, f"{sf_dir}/documents.parquet")
    return accepted.select("doc_id", F.lit("accepted").alias("outcome")).unionByName(
        rejected.select("doc_id", F.col("reason").alias("outcome")))


@query
def s3_read_feed(spark, sf_dir):
    """Entries written as XML to the run folder and read back."""
    path = new_path(spark, "feed")
    derived.load(spark, sf_dir, derived.feed_sql).select(
        "id", "title", F.when(F.col("href").isNotNull(), F.array(
            F.struct(F.lit("other").alias("_title"), F.lit("https://example.org/x").alias("_href"), F.lit("alternate").alias("_rel")),
            F.struct(F.lit("pdf").alias("_title"), F.col("href").alias("_href"), F.lit("related").alias("_rel")))).alias("link"),
    ).write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    return readers.read_feed(spark, path)


@query
def s6_read_results(spark, sf_dir):
    """Batch records written by S7 as JSON to the run folder and read back."""
    path = new_path(spark, "results")
    rows = results(spark, sf_dir).withColumn(
        "analyze_response", F.from_json("response_json", readers.RESPONSE_SCHEMA)).drop("response_json")
    INC.write_results(rows, path, "json", partition_by=["category"])
    back = readers.read_results(spark, path, by_line=True)
    return back.select(
        "paper", "category", "analyze_status", "error", "analyze_response.grade", "analyze_response.final_score",
        "analyze_response.citation_result.total_refs", F.try_element_at("analyze_response.layer_scores", F.lit("citations")).alias("citations"),
        F.array_join("analyze_response.citation_result.flagged_dois", ",").alias("flagged"))


@query
def s7_write_results(spark, sf_dir):
    """A partitioned Parquet write, read back by its partition column."""
    path = new_path(spark, "written")
    INC.write_results(results(spark, sf_dir), path, partition_by=["category"])
    return spark.read.parquet(path).groupBy("category").agg(
        F.count("*").alias("n"), F.sum("analyze_time_ms").cast("bigint").alias("ms"))


@query
def s4_pick_first_available(spark, sf_dir):
    return readers.pick_first_available(
        derived.load(spark, sf_dir, derived.candidates_sql), derived.load(spark, sf_dir, derived.fallback_sql))


@query
def s5_parse_reviews(spark, sf_dir):
    rows = parsed_reviews(spark, sf_dir)
    return rows.select("doc_id", "analysis_failed", "discipline", F.explode_outer("layers").alias("x")).select(
        "doc_id", "analysis_failed", "discipline", "x.layer", "x.score",
        F.array_join("x.issues", "|").alias("issues"), F.array_join("x.suggestions", "|").alias("suggestions"))


def keyed_documents(spark, sf_dir):
    return PR.content_key(documents(spark, sf_dir), "text").select("doc_id", "content_digest")


def stored_keys(spark, sf_dir):
    d = keyed_documents(spark, sf_dir).where(F.col("doc_id") % 3 == 0)
    return d.groupBy("content_digest").agg(F.min("doc_id").alias("stored_doc"))


@query
def s9_incremental(spark, sf_dir):
    hits, misses = INC.plan_incremental(keyed_documents(spark, sf_dir), stored_keys(spark, sf_dir))
    return hits.select("doc_id", "stored_doc").unionByName(misses.select("doc_id", F.lit(-1).cast("bigint").alias("stored_doc")))


@query
def s9_merge_store(spark, sf_dir):
    new = keyed_documents(spark, sf_dir).select(
        "doc_id", "content_digest", F.col("doc_id").alias("stored_doc"), (F.col("doc_id") % 7 == 0).alias("analysis_failed"))
    return INC.merge_store(stored_keys(spark, sf_dir), new)


@query
def s9_result_store(spark, sf_dir):
    """The same merge, in place: stored keys first, then the documents in two halves, the first of them twice."""
    store = INC.ResultStore(spark, new_path(spark, "store"), "content_digest string, stored_doc bigint", rows_per_folder=5_000)
    store.merge(stored_keys(spark, sf_dir))
    new = keyed_documents(spark, sf_dir).where(F.col("doc_id") % 7 != 0).select("doc_id", "content_digest", F.col("doc_id").alias("stored_doc"))
    least = new.groupBy("content_digest").agg(F.min("stored_doc").alias("stored_doc"))
    for half in (0, 0, 1):
        store.merge(least.where(F.col("stored_doc") % 2 == half))
    return store.rows().select("content_digest", "stored_doc")


# --- reviews and scores --------------------------------------------------------

def reviews(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.reviews_sql)


def parsed_reviews(spark, sf_dir):
    return RV.parse_reviews(reviews(spark, sf_dir))


def layered(spark, sf_dir):
    """Calibrated reviews with a derived citations layer; every seventh paper has none."""
    cites = reviews(spark, sf_dir).where(F.col("doc_id") % 7 != 0).select(
        "doc_id", (F.col("doc_id") * 3 % 21 / 2.0).alias("score"),
        F.array(F.lit("citation issue")).alias("issues"), F.array(F.lit("fix citations")).alias("suggestions"))
    return RV.add_citations_layer(RV.calibrate(parsed_reviews(spark, sf_dir)), cites)


def scored(spark, sf_dir):
    return RV.weighted_score(layered(spark, sf_dir))


@query
def r1_layer_rows(spark, sf_dir):
    return RV.layer_rows(parsed_reviews(spark, sf_dir)).select("doc_id", "layer", "score")


@query
def r2_calibrate(spark, sf_dir):
    return RV.layer_rows(layered(spark, sf_dir)).select("doc_id", "layer", "score")


@query
def r3_resolve_discipline(spark, sf_dir):
    raw = reviews(spark, sf_dir).select("doc_id", F.get_json_object("review_json", "$.discipline").alias("discipline"))
    return RV.resolve_discipline(raw)


@query
def r4_weighted_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "discipline", "final_score")


@query
def r4_weighted_score_by_table(spark, sf_dir):
    """Weights from a table: physics takes those of mathematics, and has no row of its own for the last layer."""
    rows = [(d, l, i, w[i], SC.max_marks(w[i])) for d, w in SC.DISCIPLINE_WEIGHTS.items() for i, l in enumerate(LAYERS)]
    table = spark.createDataFrame(rows, "discipline string, layer string, ord int, weight double, max_marks int").where("discipline <> 'physics'")
    own = table.where((F.col("discipline") == "mathematics") & (F.col("ord") < 4)).withColumn("discipline", F.lit("physics"))
    out = RV.weighted_score_by(layered(spark, sf_dir), table.union(own))
    return out.select("doc_id", "discipline", "final_score", F.array_join(F.transform("marks", lambda m: m["earned"].cast("string")), ",").alias("earned"))


@query
def r5_grade(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "grade")


@query
def r6_marks(spark, sf_dir):
    return RV.marks(layered(spark, sf_dir)).select("doc_id", "layer", "max_marks", "earned")


@query
def r7_worst_layers(spark, sf_dir):
    return RV.worst_layers(layered(spark, sf_dir))


@query
def r8_verdict(spark, sf_dir):
    return RV.verdict(scored(spark, sf_dir)).select("doc_id", "verdict_text")


@query
def r9_labels(spark, sf_dir):
    return RV.labels(scored(spark, sf_dir))


@query
def r10_bands(spark, sf_dir):
    return RV.bands(scored(spark, sf_dir))


@query
def r10_confidence_bands(spark, sf_dir):
    rows = SEC.section_confidence(SEC.long_sections(bundled(spark, sf_dir)))
    return rows.groupBy("section", SC.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def r11_quota_flag(spark, sf_dir):
    return RV.quota_flag(scored(spark, sf_dir))


@query
def c11_score_drift(spark, sf_dir):
    """Drift between raw and calibrated layer scores."""
    return COMP.score_drift(RV.layer_rows(parsed_reviews(spark, sf_dir)), RV.layer_rows(layered(spark, sf_dir)))


# --- batch validation ------------------------------------------------------------

def results(spark, sf_dir):
    return derived.load(spark, sf_dir, derived.results_sql)


def meta(spark, sf_dir):
    m = derived.load(spark, sf_dir, derived.meta_sql)
    return m.withColumn("expected_sections", F.split("expected", ","))


def validations(spark, sf_dir):
    return VAL.validate(results(spark, sf_dir), meta(spark, sf_dir))


@query
def q1_check_schema(spark, sf_dir):
    r = VAL.with_response(results(spark, sf_dir)).where(F.col("keys").isNotNull())
    return r.select("paper", F.array_join(VAL.missing_keys(), ",").alias("missing"))


@query
def q2_check_ranges(spark, sf_dir):
    r = VAL.with_response(results(spark, sf_dir)).where(F.col("keys").isNotNull())
    return r.select("paper", F.explode_outer(VAL.range_errors()).alias("error")).where(F.col("error").isNotNull())


@query
def q3_check_layers(spark, sf_dir):
    r = VAL.with_response(results(spark, sf_dir)).where(F.col("keys").isNotNull())
    return r.select("paper", F.array_join(VAL.layer_warnings(), "|").alias("warnings"),
                    F.array_join(VAL.fallback_layers(), ",").alias("fallback"))


@query
def q4_section_gaps(spark, sf_dir):
    return validations(spark, sf_dir).select("paper", F.inline_outer("section_gaps")).where(
        F.col("section").isNotNull()).select("paper", "section")


@query
def q5_citation_gaps(spark, sf_dir):
    return validations(spark, sf_dir).select("paper", F.inline_outer("citation_gaps")).where(F.col("gap_type").isNotNull())


@query
def q6_check_artifacts(spark, sf_dir):
    return results(spark, sf_dir).select("paper", VAL.artifact_error().alias("error"))


@query
def q7_validate(spark, sf_dir):
    return validations(spark, sf_dir).select(
        "paper", "schema_ok", "score_ranges_ok", "layer_details_ok", "report_pdf_ok", "status",
        F.size("warnings").alias("n_warnings"), F.size("errors").alias("n_errors"))


@query
def q8_run_summary(spark, sf_dir):
    s = VAL.run_summary(validations(spark, sf_dir))
    return s.withColumn("avg_score", F.round("avg_score", 6)).withColumn("avg_time_ms", F.round("avg_time_ms", 6))


@query
def q8_observed_summary(spark, sf_dir):
    """The same summary, counted while the records are written."""
    s = VAL.write_with_summary(validations(spark, sf_dir), new_path(spark, "validations"))
    return s.withColumn("avg_score", F.round("avg_score", 6)).withColumn("avg_time_ms", F.round("avg_time_ms", 6))


@query
def q9_findings(spark, sf_dir):
    return VAL.findings(validations(spark, sf_dir))


@query
def q10_run_verdict(spark, sf_dir):
    return VAL.run_verdict(VAL.run_summary(validations(spark, sf_dir)))


@query
def q11_batch_counts(spark, sf_dir):
    c = VAL.batch_counts(results(spark, sf_dir))
    return c.withColumn("avg_time_ms", F.round("avg_time_ms", 6)).withColumn("median_time_ms", F.col("median_time_ms").cast("bigint"))


@query
def q11_merged_counts(spark, sf_dir):
    """Counts and quantiles over two batches whose sketches were stored apart."""
    r = results(spark, sf_dir)
    first = F.pmod(F.xxhash64("paper"), F.lit(2)) == 0
    batches = [materialize(VAL.latency_sketches(r.where(c))) for c in (first, ~first)]
    c = VAL.merged_counts(batches[0].union(batches[1]))
    return c.withColumn("avg_time_ms", F.round("avg_time_ms", 6))


@query
def s6_old_shapes(spark, sf_dir):
    """Records as older versions wrote them: other names, other types, keys of their own, or no JSON at all."""
    r = results(spark, sf_dir).withColumn("id", F.regexp_extract("paper", r"(\d+)", 1).cast("bigint"))
    j, i = F.col("response_json"), F.col("id")
    old = (
        F.when(i % 6 == 1, F.replace(j, F.lit('"citation_result"'), F.lit('"citations"')))
        .when(i % 6 == 2, F.replace(j, F.lit('"grade":"'), F.lit('"reviewer":"me","mark":"')))
        .when(i % 6 == 3, F.replace(j, F.lit('"final_score":'), F.lit('"final_score":"high","score":')))
        .when(i % 6 == 4, F.concat(F.lit("oops "), j)).otherwise(j))
    out = readers.tolerant_responses(r.withColumn("response_json", old))
    return out.select(
        "paper", "readable", "final_score", "grade", "total_refs", "verified", F.array_join(F.array_sort("unknown"), ",").alias("unknown"),
        F.try_element_at("layer_scores", F.lit("citations")).alias("citations"))


# --- whole jobs ------------------------------------------------------------------

def job_papers(spark, sf_dir):
    """Papers of the whole job, and as many short notes of their own, which must be rejected, as every fortieth paper makes."""
    whole = papers(spark, sf_dir).select("doc_id", "text")
    notes = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") % 40 == 3)
    return whole.union(notes.select(-1 - F.col("doc_id"), F.concat(F.lit("Note on paper "), F.col("doc_id").cast("string"))))


def job_reviews(spark, sf_dir):
    """Reviews of the whole job: every twenty-ninth paper has none."""
    return reviews(spark, sf_dir).where(F.col("doc_id") % 29 != 7)


def analysis(spark, sf_dir):
    return PLAN.analyze_corpus(
        job_papers(spark, sf_dir), links(spark, sf_dir), heading_map(spark, sf_dir), job_reviews(spark, sf_dir),
        works(spark, sf_dir), preprints(spark, sf_dir), NOW, lookup_log(spark, sf_dir))


@query
def r12_analysis_record(spark, sf_dir):
    """The nested record, a row per layer: raw score in the details, calibrated score, texts, marks."""
    a = analysis(spark, sf_dir)
    rows = a.select(
        "doc_id", "analysis_failed", "layer_scores", "layer_max_marks", "verdict_text",
        F.array_join(F.array_sort(F.map_keys("detected_sections")), ",").alias("detected"),
        "citation_result.unreachable", F.size("citation_result.flagged_items").alias("n_flagged"),
        F.explode("layer_details").alias("layer", "d"))
    return rows.select(
        "doc_id", "analysis_failed", "layer", F.col("d.score").alias("raw_score"), F.array_join("d.issues", "|").alias("issues"),
        F.array_join("d.suggestions", "|").alias("suggestions"), F.try_element_at("layer_scores", F.col("layer")).alias("score"),
        F.try_element_at("layer_max_marks", F.col("layer")).alias("max_marks"), "verdict_text", "detected", "unreachable", "n_flagged")


@query
def e1_analyze_corpus(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return a.select(
        "doc_id", "content_key", "analysis_failed", "section_count", F.array_join("warnings", ",").alias("warnings"),
        "discipline", "final_score", "grade",
        *[F.try_element_at("layer_scores", F.lit(l)).alias(l) for l in LAYERS],
        "citation_result.total_refs", "citation_result.verified")


@query
def e2_analyze_stream(spark, sf_dir):
    """The same papers arriving as files, in two runs of the stream."""
    base = new_path(spark, "stream")
    source, out, marks = (f"{base}/{name}" for name in ("in", "out", "marks"))
    parts = job_papers(spark, sf_dir)
    given = job_reviews(spark, sf_dir)
    for half in (0, 1):
        parts.where(F.col("doc_id") % 2 == half).write.mode("append").parquet(source)
        STREAM.analyze_stream(
            spark, source, out, marks, NOW, lambda p: p.select("doc_id").join(given, "doc_id"), works(spark, sf_dir),
            preprints(spark, sf_dir), heading_map(spark, sf_dir), lookup_log(spark, sf_dir)).awaitTermination()
    return spark.read.parquet(out).select(
        "doc_id", "content_key", "analysis_failed", "section_count", "final_score", "grade",
        "citation_result.total_refs", "citation_result.verified")


@query
def e3_validate_batch(spark, sf_dir):
    out = PLAN.validate_batch(results(spark, sf_dir), meta(spark, sf_dir))
    return out["findings"].groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e1_analyze_corpus"](spark, sf_dir)
