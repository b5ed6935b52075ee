"""Upkeep of results as sources change: change logs, freshness, refcounts, affected-key recomputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def reload_kind(path: Column) -> Column:
    """What a change of a path asks for."""
    return F.when(path.endswith(".mit"), "recompile").when(path.contains("dictionary/"), "revalidate").otherwise("full")


def latest_changes(events: DataFrame, path: str, op: str, order: list[str]) -> DataFrame:
    """The last operation of each path; one row a path whatever the number of events."""
    return events.groupBy(path).agg(F.max_by(op, F.struct(*order)).alias(op), F.count("*").alias("events"))


def quiet_sessions(events: DataFrame, path: str, ts: str, gap_seconds: int) -> DataFrame:
    """Bursts of a path's events with no pause of gap_seconds or more inside."""
    order = Window.partitionBy(path).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    begins = F.when(seconds - F.lag(seconds).over(order) < gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = events.withColumn("_b", begins).withColumn("session", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(path, "session").agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def sweep(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key and state of every source: new, removed, changed (size or hash) or fresh. Both have size and hash."""
    a, b = now.select(key, F.col("size").alias("s1"), F.col("hash").alias("h1")), before.select(key, F.col("size").alias("s0"), F.col("hash").alias("h0"))
    state = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "removed").when((F.col("s0") != F.col("s1")) | (F.col("h0") != F.col("h1")), "changed").otherwise("fresh")
    return a.join(b, key, "full").select(key, state.alias("state"))


def upsert(state: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """state with the rows of changed and removed keys gone and changed rows in."""
    touched = changed.select(key).unionByName(removed.select(key)).distinct()
    return state.join(touched, key, "left_anti").unionByName(changed)


def deltas(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Signed contributions of a change: the old rows taken back, the new ones added."""
    return old.select(*keys, F.lit(-1).alias("delta")).unionByName(new.select(*keys, F.lit(1).alias("delta")))


def refcounts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of signed deltas; what falls to nothing is gone."""
    return changes.groupBy(*keys).agg(F.sum("delta").alias("refs")).filter("refs > 0")


def recheck(state: DataFrame, touched: DataFrame, sources: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """state with only touched keys computed anew from sources; equal to computing all of it."""
    keys = touched.select(key).distinct()
    return state.join(keys, key, "left_anti").unionByName(compute(sources.join(keys, key, "left_semi")))


def structural(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys whose change is structural: new or removed, clean flipped, or another skeleton."""
    a = now.select(key, F.col("clean").alias("c1"), F.col("skeleton").alias("k1"))
    b = before.select(key, F.col("clean").alias("c0"), F.col("skeleton").alias("k0"))
    same = F.col("c0").eqNullSafe(F.col("c1")) & F.col("k0").eqNullSafe(F.col("k1"))
    return a.join(b, key, "full").filter(F.col("c0").isNull() | F.col("c1").isNull() | ~same).select(key)


def submission_state(signed_in: Column, on_submission: Column, changes: Column, pull: Column) -> Column:
    """Where a contribution stands: signedOut, clean, editing, unfinished, sent or decided; pull is null, open or closed."""
    own = F.when(changes == 0, "clean").otherwise("editing")
    return F.when(~signed_in, "signedOut").when(~on_submission, own).when(pull.isNull(), "unfinished").when(pull == "open", "sent").otherwise("decided")


def pending_writes(queue: DataFrame) -> DataFrame:
    """What a queue of writes (seq, kind, path) comes to: a full write stands for all before it, and of each
    path the last operation counts; a dictionary write is one."""
    full = queue.filter("kind = 'full'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_full"))
    after = queue.crossJoin(F.broadcast(full)).filter(F.col("seq") >= F.col("_full"))  # one row
    target = F.when(F.col("kind") == "full", "*").when(F.col("kind") == "dictionary", "dictionary").otherwise(F.col("path"))
    return after.groupBy(target.alias("target")).agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


def fold_stream(stream: DataFrame, target: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str):
    """A query that folds each micro-batch into the table at target; a batch that runs again replaces its own result.

    Results go to target/batch=N from target/batch=N-1, so a lost or repeated batch leaves the same table; the one before that is then of no more use and goes.
    """

    def forget(spark: SparkSession, number: int) -> None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={number}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{target}/batch={number - 1}") if number else None
        fold(batch, before).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if number > 1:
            forget(spark, number - 2)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
