"""Shared plumbing: staged tables, joins that stand hot keys, package shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]

#: At most this many keys can each hold more than 1/HOT_SHARE of the rows.
HOT_SHARE = 1000

#: The place of null ids in the order of ids.
LAST = 2**63 - 1

#: Spark's setting that lets shuffle files go with the execution that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make the package importable on executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_lexloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in (ROOT / "lexloom").rglob("*.py"):
            z.write(path, path.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._lexloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a local master gets a folder of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lexloom_dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        base = sc._lexloom_dir = "file://" + tempfile.mkdtemp(prefix="lexloom-checkpoint-")
    return base.rstrip("/")


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: a loop of many small jobs leaves plans and generated classes that would pile up in its memory."""
    spark.sparkContext._jvm.System.gc()


class Stage:
    """Tables written in the shared folder to cut lineage; dropped when the process ends or on close()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back; shuffle files of the write go when it ends, for nothing reads them again."""
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join rows with groups, where key is unique in groups and size counts a group's rows.

    Groups above 1/HOT_SHARE of the rows number HOT_SHARE at most, so they are broadcast and
    their rows never meet in a task; each other key brings few rows to the shuffled join.
    """
    cut = max(64, n_rows // HOT_SHARE)
    hot = groups.filter(F.col(size) > cut)
    cold = groups.filter(F.col(size) <= cut)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )


def row_key(docs: DataFrame) -> Column:
    """doc_id as a long; null ids are one id behind all others."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))


def row_tag(docs: DataFrame) -> Column:
    """A hash of the text that tells rows of one doc_id apart."""
    return F.xxhash64(docs["text"])


def with_rows(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each key and tag in picked; of rows that repeat both, any one.

    Repeats go in each task first, so they don't meet in the shuffle.
    """
    key, tag, rank = (free_name(docs, x) for x in ("_key", "_tag", "_rank"))
    marked = docs.withColumns({key: row_key(docs), tag: row_tag(docs)})
    once = marked.withColumn(rank, F.row_number().over(Window.partitionBy(key, tag).orderBy(key))).filter(F.col(rank) == 1)
    return once.join(picked.select(F.col("key").alias(key), F.col("tag").alias(tag)).distinct(), [key, tag], "left_semi").select(*docs.columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
