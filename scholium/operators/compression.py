"""Section compression and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.constants import COMPRESSION_THRESHOLD, DRIFT_TOLERANCE
from scholium.functions import compression as CF
from scholium.functions.text import round_exact
from scholium.operators.frames import pin


def compress_sections(sections: DataFrame, mode: str = "light") -> DataFrame:
    """Long sections with ``compressed``; narrow, any section names."""
    return pin(sections, compressed=CF.compress(F.col("section"), F.col("text"), mode))


def compressed_texts(bundled: DataFrame, mode: str = "light", shield: bool = True) -> DataFrame:
    """Adds ``texts``: the eight compressed texts of a document in section order.

    With ``shield`` the methodology text stays raw, as prompts send it.
    """

    def one(s: Column) -> Column:
        done = CF.compress(s["section"], s["text"], mode)
        return F.when(s["section"] == "methodology", s["text"]).otherwise(done) if shield else done

    return pin(bundled, texts=F.transform("sections", one))


def reduction(original: Column, compressed: Column) -> Column:
    return F.when(
        original > 0, round_exact((F.lit(1.0) - compressed / original) * 100.0, 1)
    ).otherwise(0.0)


def compression_stats(compressed: DataFrame) -> DataFrame:
    """Characters before and after per section, per document and overall (rollup of lengths)."""
    sizes = compressed.where(F.col("section") != "references").select(
        "doc_id", "section",
        F.length("text").cast("long").alias("o"), F.length("compressed").cast("long").alias("c"),
    )
    rolled = sizes.rollup("doc_id", "section").agg(
        F.grouping_id().alias("g"), F.sum("o").alias("original"), F.sum("c").alias("compressed")
    )
    level = F.when(F.col("g") == 0, "section").when(F.col("g") == 1, "paper").otherwise("corpus")
    return rolled.select(
        level.alias("level"), "doc_id", "section",
        F.coalesce("original", F.lit(0)).alias("original"),
        F.coalesce("compressed", F.lit(0)).alias("compressed"),
        reduction(F.col("original"), F.col("compressed")).alias("pct"),
    )


def compression_report(stats: DataFrame, threshold: float = COMPRESSION_THRESHOLD) -> DataFrame:
    """One row: totals, overall reduction against the threshold, number of sections that grew."""
    rows = stats.where(F.col("level") == "section")
    total = rows.agg(
        F.countDistinct("doc_id").alias("papers"),
        F.coalesce(F.sum("original"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("compressed"), F.lit(0)).alias("compressed"),
        F.count_if(F.col("compressed") > F.col("original")).alias("grew"),
    )
    out = total.withColumn("pct", reduction(F.col("original"), F.col("compressed")))
    return out.withColumn("meets_threshold", F.col("pct") >= threshold)


def score_drift(a: DataFrame, b: DataFrame, tol: float = DRIFT_TOLERANCE) -> DataFrame:
    """Score change per layer between two (doc_id, layer, score) frames, with the largest per doc."""
    left = a.select("doc_id", "layer", F.col("score").alias("score_a"))
    right = b.select("doc_id", "layer", F.col("score").alias("score_b"))
    joined = left.join(right, ["doc_id", "layer"], "left")
    layer = joined.select(
        "doc_id", "layer", "score_a", F.coalesce("score_b", F.lit(0.0)).alias("score_b")
    ).withColumn("delta", F.abs(F.col("score_b") - F.col("score_a")))
    per_doc = layer.groupBy("doc_id").agg(
        F.collect_list(F.struct("layer", "score_a", "score_b", "delta")).alias("rows"),
        F.max("delta").alias("max_delta"),
    )
    return per_doc.select("doc_id", "max_delta", F.inline("rows")).withColumn(
        "status", F.when(F.col("delta") <= tol, "OK").otherwise("DRIFT")
    )
