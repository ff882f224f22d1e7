"""Papers analysed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholium.plans.analyze import analyze_prepared, prepare_corpus
from scholium.sources.incremental import ResultStore, plan_incremental
from scholium.sources.shared import new_path, remove

PAPER_SCHEMA = "doc_id bigint, text string"


def analyze_stream(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str, now: int,
    reviews_of: Callable[[DataFrame], DataFrame], works: DataFrame, preprints: DataFrame,
    heading_map: DataFrame | None = None, log: DataFrame | None = None,
    max_files: int = 100, dice: bool = False, rows_per_folder: int = 100_000,
) -> StreamingQuery:
    """A result per usable arriving paper; a review stored for the same content is reused.

    Every micro-batch runs the batch job: references are always checked anew, only reviews are taken from
    the store ``<out_path>_reviews``, which holds one row per content (:class:`scholium.sources.incremental.ResultStore`);
    a batch reads and rewrites only the store's folders that its own digests fall into. A batch's records go to a folder named by
    the batch, which a repeated batch overwrites, and merging a review again changes nothing, so a restart
    neither loses nor doubles results.
    ``reviews_of`` maps (doc_id, content_digest, prompt), one row per content without a stored
    review, to (doc_id, review_json). Intermediate tables of a batch are removed at its end.
    """
    papers = (
        spark.readStream.schema(PAPER_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(in_path)
    )
    reviews = ResultStore(spark, f"{out_path}_reviews", rows_per_folder=rows_per_folder)

    def run(batch: DataFrame, batch_id: int) -> None:
        folder = new_path(spark, f"batch-{batch_id}")
        steps = iter(range(1 << 30))

        def cut(df: DataFrame) -> DataFrame:
            path = f"{folder}/{next(steps)}"
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        facts, prompts = prepare_corpus(batch, None, heading_map, now, cut=cut)
        known = cut(reviews.lookup(prompts.select("content_digest")))
        wanted = plan_incremental(prompts, known)[1]
        once = wanted.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id"))
        fresh = cut(wanted.join(once, ["doc_id", "content_digest"], "left_semi"))
        reviewed = cut(
            reviews_of(fresh).join(fresh.select("doc_id", "content_digest"), "doc_id").select("content_digest", "review_json"))
        both = reviewed.unionByName(known)
        nobody = prompts.select("doc_id", F.lit(None).cast("string").alias("review_json")).limit(0)
        records = cut(analyze_prepared(facts, nobody, works, preprints, log, dice, cut, both))
        records.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        good = records.where(~F.col("analysis_failed")).select("content_digest").distinct()
        reviews.merge(reviewed.join(good, "content_digest", "left_semi"))
        remove(spark, folder)

    return (
        papers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
