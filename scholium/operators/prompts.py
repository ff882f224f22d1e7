"""Prompt operators: captions, assembly, token budget, content keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.constants import (
    BUDGET_LIMITS, CHARS_PER_TOKEN, PROMPT_OVERHEAD_CHARS, TOKENS_PER_MINUTE,
)
from scholium.functions import prompts as PF
from scholium.functions.text import first_n, round_exact
from scholium.operators.frames import pin


def captions(with_texts: DataFrame, cap: int | None = None) -> DataFrame:
    """(doc_id, pos, caption) from a frame with ``texts``; the first ``cap`` of each document, if given."""
    found = pin(with_texts.select("doc_id", "texts"), found=PF.captions(F.col("texts")))
    return found.select(
        "doc_id", F.posexplode_outer(first_n(F.col("found"), cap)).alias("pos", "caption")
    ).where(F.col("pos").isNotNull())


def assemble_prompt(with_texts: DataFrame, **limits) -> DataFrame:
    """Adds ``prompt``, ``content_key`` and ``content_digest``; an empty prompt means a paper without content.

    ``limits`` are those of :func:`scholium.functions.prompts.assemble`; none apply by default.
    """
    caps = pin(with_texts, caps=PF.captions(F.col("texts")))
    out = pin(caps, prompt=PF.assemble(F.col("texts"), F.col("caps"), **limits)).drop("caps")
    return content_key(out, "prompt")


def content_key(df: DataFrame, col: str, n: int = 16) -> DataFrame:
    """Adds the digest of a text, whole for joins and its first ``n`` digits for display."""
    digested = df.withColumn("content_digest", F.sha2(col, 256))
    return digested.withColumn("content_key", F.substr("content_digest", F.lit(1), F.lit(n)))


def token_budget(
    sections: DataFrame, limits: list[tuple[str, int]] = BUDGET_LIMITS, tpm: int = TOKENS_PER_MINUTE
) -> DataFrame:
    """Characters, tokens and characters sent, rolled up per section, document and corpus.

    ``papers_per_minute`` is what the quota allows for a paper of that size.
    """
    limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    sizes = sections.select(
        "doc_id", "section", F.length("text").cast("long").alias("chars"),
        F.least(
            F.length("text"), F.coalesce(F.try_element_at(limit, F.col("section")), F.lit(0))
        ).cast("long").alias("sent"),
    )
    rolled = sizes.rollup("doc_id", "section").agg(
        F.grouping_id().alias("g"), F.sum("chars").alias("chars"), F.sum("sent").alias("sent")
    )
    tokens = F.floor((F.col("sent") + PROMPT_OVERHEAD_CHARS) / CHARS_PER_TOKEN)
    return rolled.select(
        F.when(F.col("g") == 0, "section").when(F.col("g") == 1, "paper").otherwise("corpus")
        .alias("level"),
        "doc_id", "section", "chars", "sent",
        F.floor(F.col("chars") / CHARS_PER_TOKEN).alias("tokens"),
        round_exact(F.col("sent") / F.col("chars") * 100.0, 1).alias("share"),
        F.when(F.col("g") == 1, F.floor(F.lit(tpm) / tokens)).alias("papers_per_minute"),
    )
