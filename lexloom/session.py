"""The session settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hand only below this many bytes of Catalyst's estimate; beyond it Spark shuffles.
BROADCAST_BYTES = 32 << 20


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and last-wins map merging; conf overrides."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName("lexloom")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if Catalyst bounds it below limit; else as it is, and joins shuffle."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if estimate <= limit else df


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, with its lineage cut; local masters get a folder of their own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="lexloom-settled-"))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written once, compressed by columns, to the shared checkpoint folder and read back: for what several parts of a query read."""
    sc = df.sparkSession.sparkContext
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="lexloom-kept-")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
