"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; bounds the worker's memory whatever the texts' lengths.
BATCH_BYTES = 8 << 20

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one only where that is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        root = tempfile.mkdtemp(prefix="scholium-llm-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored frame that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame once as Parquet in the shared folder (at ``path``, if given) and go on from the files.

    Cuts the plan, lets later steps prune columns, and survives lost executors. The shuffle files behind it
    are not needed any more and are removed at once.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored frames of one job, deleted together once its last result is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        return store(df, self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()


#: Stands for a null id between the steps of an operator.
NO_ID = -(1 << 63)


def told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, text, twin, n`` and whether ids are unique: rows of one id and text as one, ``n`` of them; ``twin`` tells rows of one id apart.

    The first byte of ``twin`` is 0 where the id is null (``doc_id`` is then NO_ID), else 1; where ids repeat, a digest of the text follows.
    """
    known = with_twin(docs, F.lit(b""))
    if known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty():
        return known.withColumn("n", F.lit(1).cast("long")), True
    known = with_twin(docs)
    return store(known.groupBy("doc_id", "twin").agg(F.first("text").alias("text"), F.count("*").alias("n"))), False


def with_twin(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """``doc_id, text, twin`` and all other columns; see :func:`told_apart`."""
    flag = F.when(F.col("doc_id").isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01"))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) if digest is None else digest
    return docs.withColumns({"twin": F.concat(flag, digest), "doc_id": F.coalesce("doc_id", F.lit(NO_ID))})


def own_id() -> Column:
    """The id of a row with a ``twin``, null again where it was null."""
    return F.when(F.substring("twin", 1, 1) == F.lit(b"\x01"), F.col("doc_id"))


#: Copies of a row that are made in one array.
REPEATED_AT_ONCE = 100_000


def repeat(rows: DataFrame, count: str) -> DataFrame:
    """Every row as often as ``count`` says, in steps that bound the arrays it takes."""
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / REPEATED_AT_ONCE))))
    left = F.least(F.lit(REPEATED_AT_ONCE), F.col(count) - F.col("_block") * REPEATED_AT_ONCE)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("_block", "_copy")


def limit_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, once=None) -> DataFrame:
    """``mapInArrow`` of a function on single batches; ``once()`` makes its second argument, once per task."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = once() if once else None
        for batch in batches:
            out = fn(batch, state) if once else fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names: columns of any other name cannot clash with an operator's own."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Whether a row must not be learned from: crc32 of the id as text, modulo 3, is 1 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def stable_seed(text: str) -> int:
    return zlib.crc32(text.encode())


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
