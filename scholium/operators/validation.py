"""Batch validation. Each record is checked inside its row; only the summary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scholium.constants import (
    DISPLAY_NAME, GRADE_TEXT, LAYERS, MIN_REPORT_BYTES, RESULT_KEYS, STALE_FALLBACK_ISSUE,
)
from scholium.functions.scoring import lookup
from scholium.operators.frames import pin
from scholium.sources.readers import RESULT_SCHEMA

RESPONSE_SCHEMA = RESULT_SCHEMA[RESULT_SCHEMA.index("struct<"):]
GRADE_LIST = "[" + ", ".join(f"'{g}'" for g in GRADE_TEXT.values()) + "]"
INTERNAL_NAME = {v: k for k, v in DISPLAY_NAME.items()}


def with_response(results: DataFrame) -> DataFrame:
    """Adds the key list and typed response to records with analyze_response or response_json."""
    if "analyze_response" in results.columns:
        results = results.withColumn("response_json", F.to_json("analyze_response")).drop("analyze_response")
    return pin(
        results,
        keys=F.json_object_keys("response_json"),
        r=F.from_json("response_json", RESPONSE_SCHEMA),
    ).drop("response_json")


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _quoted(items: Column) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
        F.lit("]"),
    )


def missing_keys() -> Column:
    return F.array_except(F.array(*map(F.lit, RESULT_KEYS)), F.coalesce("keys", F.array().cast("array<string>")))


def range_errors() -> Column:
    scores = F.map_entries(F.coalesce(
        F.col("r.layer_scores"), F.create_map().cast("map<string,double>")))
    layer = F.transform(
        scores,
        lambda e: F.when(e["value"].isNull(), F.concat(
            F.lit("layer_scores."), e["key"], F.lit(" is not a number: None")))
        .when((e["value"] < 0) | (e["value"] > 10), F.concat(
            F.lit("layer_scores."), e["key"], F.lit(" out of range [0,10]: "),
            e["value"].cast("string"))),
    )
    final = F.when(
        ~F.array_contains("keys", "final_score"), F.lit("final_score out of range [0,100]: -1")
    ).when(F.col("r.final_score").isNull(), F.lit("final_score is not a number: None")).when(
        ~F.col("r.final_score").between(0, 100),
        F.concat(F.lit("final_score out of range [0,100]: "), F.col("r.final_score").cast("string")),
    )
    grade = F.coalesce("r.grade", F.lit(""))
    bad_grade = F.when(
        ~grade.isin(list(GRADE_TEXT.values())),
        F.concat(F.lit("Invalid grade: '"), grade, F.lit(f"' (expected one of {GRADE_LIST})")),
    )
    return F.filter(F.concat(layer, F.array(final, bad_grade)), lambda x: x.isNotNull())


def layer_warnings() -> Column:
    parts = []
    for name in LAYERS:
        d = F.try_element_at("r.layer_details", F.lit(name))

        def missing(field: str) -> Column:
            return F.when(d[field].isNull(), f"layer_details.{name} missing '{field}'").when(
                F.size(d[field]) == 0, f"layer_details.{name} '{field}' is empty or not a list")

        own = F.array(
            F.when(d["score"].isNull(), f"layer_details.{name} missing 'score'"),
            missing("issues"), missing("suggestions"),
            F.when((d["score"] == 0) & F.lit(name != "citations"),
                   f"layer {name} returned score 0 — possible analysis failure"),
        )
        absent = F.array(F.lit(f"Missing layer_details entry: {name}"))
        parts.append(F.when(d.isNull(), absent).otherwise(own))
    return F.filter(F.concat(*parts), lambda x: x.isNotNull())


def fallback_layers() -> Column:
    """Layers that hold a fallback review, by its text or by the failure mark."""
    hits = []
    for name in LAYERS:
        d = F.try_element_at("r.layer_details", F.lit(name))
        stale = F.exists(F.coalesce(d["issues"], F.array().cast("array<string>")),
                         lambda i: F.contains(i, F.lit(STALE_FALLBACK_ISSUE)))
        hits.append(F.when(stale | F.coalesce(d["analysis_failed"], F.lit(False)), F.lit(name)))
    return _present(*hits)


def section_gaps() -> Column:
    shown = F.map_keys(F.coalesce(F.col("r.detected_sections"), F.create_map().cast("map<string,int>")))
    found = F.transform(shown, lambda s: F.coalesce(lookup(INTERNAL_NAME, s), F.lower(s)))
    expected = F.coalesce("expected_sections", F.array().cast("array<string>"))
    return F.transform(
        F.filter(expected, lambda s: ~F.array_contains(found, s)),
        lambda s: F.struct(F.lit("missing_section").alias("gap_type"), s.alias("section"),
                           F.lit(True).alias("expected"), F.lit(False).alias("detected")),
    )


def citation_gaps() -> Column:
    refs = F.coalesce("r.citation_result.total_refs", F.lit(0))
    verified = F.coalesce("r.citation_result.verified", F.lit(0))
    flagged = F.coalesce(F.size("r.citation_result.flagged_dois"), F.lit(0))
    return _present(
        F.when((F.col("expected_ref_count") > 5) & (refs == 0), F.struct(
            F.lit("citation_extraction_failure").alias("gap_type"),
            F.concat(F.lit("Expected ~"), F.col("expected_ref_count").cast("string"),
                     F.lit(" refs but found 0")).alias("detail"))),
        F.when(F.coalesce("has_dois", F.lit(False)) & (refs > 0) & (verified == 0) & (flagged <= 0), F.struct(
            F.lit("doi_extraction_failure").alias("gap_type"),
            F.concat(F.lit("Paper expected to have DOIs but none were extracted (total_refs="),
                     refs.cast("string"), F.lit(")")).alias("detail"))),
    )


def artifact_error() -> Column:
    size = F.coalesce("report_size_bytes", F.lit(0))
    return F.when(size <= 0, "Report PDF not found").when(
        size < MIN_REPORT_BYTES,
        F.concat(F.lit("Report PDF too small ("), size.cast("string"), F.lit(" bytes, expected ≥5000)")),
    )


def validate(results: DataFrame, meta: DataFrame) -> DataFrame:
    """One validation record per result; records without a response fail."""
    joined = with_response(results).join(
        meta.select("paper", "expected_sections", "has_dois", "expected_ref_count"), "paper", "left")
    checked = pin(
        joined,
        missing=missing_keys(), ranges=range_errors(), layer_notes=layer_warnings(),
        fallback_layers=fallback_layers(), section_gaps=section_gaps(),
        citation_gaps=citation_gaps(), report_error=artifact_error(),
    )
    answered = F.col("keys").isNotNull()

    def when_answered(col: str) -> Column:
        return F.when(answered, F.col(col)).otherwise(F.slice(col, 1, 0))

    warnings = F.concat(
        _present(F.when(F.size("fallback_layers") > 0, F.concat(
            F.lit("Fallback layers (Gemini parse failure): "), _quoted(F.col("fallback_layers"))))),
        F.col("layer_notes"),
        _present(F.when(F.size("section_gaps") > 0, F.concat(
            F.lit("Expected sections not detected: "),
            _quoted(F.transform("section_gaps", lambda g: g["section"]))))),
        F.transform("citation_gaps", lambda g: F.concat(
            F.lit("Citation gap: "), g["gap_type"], F.lit(" — "), g["detail"])),
    )
    errors = F.concat(
        _present(F.when(F.size("missing") > 0, F.concat(
            F.lit("Missing schema keys: "), _quoted(F.col("missing"))))),
        F.col("ranges"),
        _present(F.when(F.col("report_error").isNotNull(),
                        F.concat(F.lit("Report PDF: "), F.col("report_error")))),
    )
    no_response = F.array(F.concat(
        F.lit("Analysis failed: "), F.coalesce("error", F.lit("unknown error"))))
    out = pin(
        checked,
        warnings=F.when(answered, warnings).otherwise(F.slice("layer_notes", 1, 0)),
        errors=F.when(answered, errors).otherwise(no_response),
    )
    return out.select(
        "paper", "title", "category", "analyze_status", "analyze_time_ms",
        F.col("r.final_score").alias("final_score"), F.col("r.grade").alias("grade"),
        (answered & (F.size("missing") == 0)).alias("schema_ok"),
        (answered & (F.size("ranges") == 0)).alias("score_ranges_ok"),
        (answered & (F.size("layer_notes") == 0) & (F.size("fallback_layers") == 0))
        .alias("layer_details_ok"),
        (answered & F.col("report_error").isNull()).alias("report_pdf_ok"),
        when_answered("fallback_layers").alias("fallback_layers"),
        when_answered("section_gaps").alias("section_gaps"),
        when_answered("citation_gaps").alias("citation_gaps"),
        "warnings", "errors",
        F.when(F.size("errors") > 0, "FAIL").when(F.size("warnings") > 0, "WARN")
        .otherwise("PASS").alias("status"),
    )


def _summary_metrics() -> list[Column]:
    def total(col: str) -> Column:
        return F.coalesce(F.sum(F.size(col)), F.lit(0)).alias(f"total_{col}")

    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")],
        F.coalesce(F.avg("final_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg(F.when(F.col("analyze_time_ms") > 0, F.col("analyze_time_ms"))), F.lit(0.0))
        .alias("avg_time_ms"),
        *[total(c) for c in ("fallback_layers", "section_gaps", "citation_gaps", "warnings", "errors")],
    ]


def run_summary(validations: DataFrame) -> DataFrame:
    return validations.agg(*_summary_metrics())


def write_with_summary(validations: DataFrame, path: str) -> DataFrame:
    """Write validation records and return their summary, which is counted while they are written: one scan."""
    seen = Observation()
    validations.observe(seen, *_summary_metrics()).write.mode("overwrite").parquet(path)
    schema = run_summary(validations).schema
    return validations.sparkSession.createDataFrame([tuple(seen.get[f.name] for f in schema)], schema)


def run_verdict(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.when(F.col("fail") > 0, "FAILURES DETECTED").when(F.col("warn") > 0, "WARNINGS FOUND")
        .otherwise("ALL CLEAR").alias("verdict"))


def findings(validations: DataFrame) -> DataFrame:
    """One row per gap, fallback layer or error: (paper, kind, item, detail)."""
    no_detail = F.lit(None).cast("string")

    def entry(kind: str, item: Column, detail: Column = no_detail) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"), detail.alias("detail"))

    rows = F.concat(
        F.transform("section_gaps", lambda g: entry("section_gap", g["section"])),
        F.transform("citation_gaps", lambda g: entry("citation_gap", g["gap_type"], g["detail"])),
        F.transform("fallback_layers", lambda l: entry("fallback_layer", l)),
        F.transform("errors", lambda e: entry("error", e)),
    )
    return validations.select("paper", F.explode_outer(rows).alias("f")).where(
        F.col("f").isNotNull()).select("paper", "f.*")


def batch_counts(results: DataFrame) -> DataFrame:
    """Success and failure counts and latency by category."""
    ok = F.col("analyze_status") == 200
    return results.groupBy("category").agg(
        F.count_if(ok).alias("success"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
        F.avg("analyze_time_ms").alias("avg_time_ms"),
        F.percentile_approx("analyze_time_ms", 0.5, 10000).alias("median_time_ms"),
    )


def latency_sketches(results: DataFrame, k: int = 4_000) -> DataFrame:
    """Counts and a quantile sketch of the latency by category, small enough to be stored for every batch.

    Sketches of several batches add up (:func:`merged_counts`). Up to about ``k`` latencies are kept as they are; beyond
    that ranks are off by about 1.7 / k.
    """
    ok = F.coalesce(F.col("analyze_status") == 200, F.lit(False))
    return results.groupBy("category").agg(
        F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.sum("analyze_time_ms").alias("time_ms"),
        F.count("analyze_time_ms").alias("timed"), F.kll_sketch_agg_bigint("analyze_time_ms", k).alias("latency"),
    )


def merged_counts(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9), k: int = 4_000) -> DataFrame:
    """Counts, mean and quantiles of the latency by category over the sketches of any number of batches."""
    both = sketches.groupBy("category").agg(
        F.sum("success").alias("success"), F.sum("failed").alias("failed"), (F.sum("time_ms") / F.sum("timed")).alias("avg_time_ms"),
        F.sum("timed").alias("timed"), F.kll_merge_agg_bigint("latency", k).alias("latency"))
    quantiles = [
        F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("latency", F.lit(r))).alias(f"p{round(100 * r)}_time_ms") for r in ranks]
    return both.select("category", "success", "failed", "avg_time_ms", *quantiles)
