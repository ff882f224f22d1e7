"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``.

    A local folder, removed when the program ends, only in local mode without that setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/scholium-{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="scholium-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str = "step") -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, once nothing reads them any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def give_back(spark: SparkSession) -> None:
    """Have the driver return memory that only planning needed.

    Long expressions make much garbage while they are parsed, planned and compiled. The heap grows for that and keeps its
    size, though little of it stays in use, until it is collected as a whole.
    """
    spark._jvm.System.gc()


#: Files of a bucketed table at most, about; beyond it rows are first dealt to their buckets.
MOST_BUCKET_FILES = 100_000


class Bucketed:
    """Tables bucketed by ``key`` of one job: joins and aggregations by that key read them without an exchange.

    A task writes the rows of each bucket to a file of its own, so writing moves nothing. Where that would make more
    than ``MOST_BUCKET_FILES`` files, rows go to their buckets in one exchange first; that is then the only
    one of the job that carries them. ``buckets`` defaults to the session's number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, key: str = "doc_id", buckets: int | None = None):
        self.spark, self.key = spark, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[tuple[str, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path, name = new_path(self.spark, "bucketed"), f"scholium_{uuid.uuid4().hex}"
        if df.rdd.getNumPartitions() * self.buckets > MOST_BUCKET_FILES:
            df = df.repartition(self.buckets, self.key)
        df.write.bucketBy(self.buckets, self.key).option("path", path).saveAsTable(name)
        self.tables.append((name, path))
        return self.spark.table(name)

    def remove(self) -> None:
        """Drop the tables and their files, once nothing reads them any more."""
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
        self.tables.clear()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet to the shared folder and go on from there.

    Used where several branches read one costly result: unlike a cache it survives lost
    executors, the plan behind it is cut, and each branch reads only its columns and row groups.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
