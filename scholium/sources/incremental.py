"""Incremental analysis: papers whose content key has a stored result are not analysed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scholium.operators.lookup import lookup_join
from scholium.sources.shared import exists, mark, new_path, remove

#: Digits of a folder's name at most: 16**6 folders.
MOST_DIGITS = 6


def plan_incremental(prompts: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the stored columns, misses), joined on the whole ``content_digest``.

    Copies of one paper share a digest, which may be hot.
    """
    marked = store.withColumn("_stored", F.lit(True))
    joined = lookup_join(prompts, marked, "content_digest")
    hits = joined.where(F.col("_stored")).drop("_stored")
    misses = joined.where(F.col("_stored").isNull()).select(prompts.columns)
    return hits, misses


def merge_store(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store plus the successful new results, one per key (the lowest doc_id); stored rows win."""
    columns = [c for c in store.columns if c != "content_digest"]
    picked = (
        new.where(~F.col("analysis_failed"))
        .groupBy("content_digest")
        .agg(F.min_by(F.struct(*columns), "doc_id").alias("r"))
        .select("content_digest", "r.*")
    )
    fresh = picked.join(store.select("content_digest"), "content_digest", "left_anti")
    return store.unionByName(fresh.select(store.columns))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


class ResultStore:
    """Results by content, one row per ``content_digest``, merged in place.

    Rows lie in folders named by the first digits of their digest. Looking up and merging a batch touch the
    folders of its digests only; others keep their files. When a folder outgrows ``rows_per_folder`` the store moves to
    folders of one digit more, so what a batch reads is bounded by its own digests times that number, however old
    the store is; each row is moved once per sixteen-fold growth. Merging the same rows again changes nothing,
    so a repeated batch is harmless. One writer at a time.
    """

    #: Folders that are named in a scan's filter at most; a batch that touches more is joined to all.
    MOST_NAMED = 10_000

    def __init__(self, spark: SparkSession, path: str, schema: str = "content_digest string, review_json string", rows_per_folder: int = 100_000):
        self.spark, self.path, self.rows_per_folder = spark, path, rows_per_folder
        self.schema = schema
        self.columns = [f.strip().split()[0] for f in schema.split(",")]

    def digits(self) -> int:
        """Digits in the names of the present folders, 0 before the first merge; an unfinished move does not count."""
        done = [k for k in range(1, MOST_DIGITS + 1) if exists(self.spark, f"{self.path}/digits={k}/_WHOLE")]
        return max(done, default=0)

    def rows(self, digits: int | None = None) -> DataFrame:
        """All rows, with their ``folder``."""
        digits = self.digits() if digits is None else digits
        if not digits:
            return self.spark.createDataFrame([], f"{self.schema}, folder string")
        return self.spark.read.schema(f"{self.schema}, folder string").parquet(f"{self.path}/digits={digits}")

    @staticmethod
    def _folder(digits: int) -> Column:
        return F.concat(F.lit("d"), F.substr("content_digest", F.lit(1), F.lit(digits)))

    def _touched(self, digests: DataFrame, digits: int) -> DataFrame:
        names = digests.select(self._folder(digits).alias("folder")).distinct()
        some = [r[0] for r in names.limit(self.MOST_NAMED + 1).collect()]
        rows = self.rows(digits)
        if len(some) > self.MOST_NAMED:
            return rows.join(names, "folder", "left_semi")
        return rows.where(F.col("folder").isin(some)) if some else rows.limit(0)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The stored rows of the given digests; only their folders are read."""
        digits = self.digits()
        if not digits:
            return self.rows(0).select(*self.columns)
        wanted = digests.select("content_digest").distinct()
        return self._touched(digests, digits).select(*self.columns).join(wanted, "content_digest", "left_semi")

    def merge(self, new: DataFrame) -> None:
        """Add the rows of ``new`` (the least of a digest stays; none without a digest); rows already stored win."""
        present = self.digits()
        digits = present or 1
        path = new_path(self.spark, "new-results")
        new.where(F.col("content_digest").isNotNull()).select(*self.columns).write.parquet(path)
        new = self.spark.read.schema(self.schema).parquet(path)
        old = self._touched(new, digits) if present else self.rows(0)
        values = F.struct(*self.columns)
        both = old.select(F.lit(0).alias("age"), values.alias("r")).union(new.select(F.lit(1).alias("age"), values.alias("r")))
        merged = both.groupBy("r.content_digest").agg(F.min(F.struct("age", "r")).alias("m")).select("m.r.*")
        largest = self._write(merged, digits)
        while largest > self.rows_per_folder and digits < MOST_DIGITS:
            moved = self._write(self.rows(digits).select(*self.columns), digits + 1)
            remove(self.spark, f"{self.path}/digits={digits}")
            digits, largest = digits + 1, moved
        remove(self.spark, path)

    def _write(self, rows: DataFrame, digits: int) -> int:
        """Replace the folders of the given rows; rows of the largest one."""
        rows = rows.withColumn("folder", self._folder(digits))
        count = Observation()
        per_file = rows.repartition("folder").sortWithinPartitions("folder")
        target = f"{self.path}/digits={digits}"
        (per_file.observe(count, F.count("*").alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("folder").parquet(target))
        mark(self.spark, f"{target}/_WHOLE")  # until then, an unfinished move counts for nothing
        written = count.get["rows"]
        if written <= self.rows_per_folder:
            return written
        return self.rows(digits).groupBy("folder").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
