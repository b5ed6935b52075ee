from __future__ import annotations

import random

from pyspark.sql import functions as F

from lexloom.operators import accounting
from lexloom.streaming import incremental


def test_refcounts_do_not_depend_on_order(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(5)}", rnd.choice([1, -1])) for _ in range(60)]
    want = {k: s for k in {k for k, _ in rows} if (s := sum(d for x, d in rows if x == k)) > 0}
    for _ in range(2):
        rnd.shuffle(rows)
        assert {r.k: r.refs for r in incremental.refcounts(spark.createDataFrame(rows, "k string, delta int"), ["k"]).collect()} == want


def test_saving_the_same_again_changes_nothing(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    before = incremental.refcounts(rows.withColumn("delta", F.lit(1)), ["k"])
    again = incremental.refcounts(rows.withColumn("delta", F.lit(1)).unionByName(incremental.deltas(rows, rows, ["k"])), ["k"])
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, again.collect()))


def test_recheck_equals_computing_all(spark):
    docs = spark.createDataFrame([("p", "a b"), ("q", "a a c")], "path string, text string")
    compute = lambda d: accounting.surface_counts(d, "path")
    state = compute(docs)
    for text in ("a z", "", "c c c"):
        docs = docs.withColumn("text", F.when(F.col("path") == "q", text).otherwise(F.col("text")))
        state = incremental.recheck(state, spark.createDataFrame([("q",)], "path string"), docs, compute, "path")
        assert sorted(map(tuple, state.collect())) == sorted(map(tuple, compute(docs).collect()))


def test_sweep_and_structure(spark):
    schema = "path string, size int, hash string"
    now, before = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], schema), spark.createDataFrame([("a", 1, "x"), ("b", 2, "q"), ("d", 1, "w")], schema)
    assert {r.path: r.state for r in incremental.sweep(now, before, "path").collect()} == {"a": "fresh", "b": "changed", "c": "new", "d": "removed"}
    schema = "path string, clean boolean, skeleton string"
    a, b = spark.createDataFrame([("a", True, "s"), ("b", True, "t"), ("n", True, "u")], schema), spark.createDataFrame([("a", True, "s"), ("b", False, "t"), ("o", True, "u")], schema)
    assert {r.path for r in incremental.structural(b, a, "path").collect()} == {"b", "n", "o"}


def test_upsert_and_latest(spark):
    state, changed, gone = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int"), spark.createDataFrame([("b", 9)], "k string, v int"), spark.createDataFrame([("c",)], "k string")
    assert sorted(map(tuple, incremental.upsert(state, changed, gone, "k").collect())) == [("a", 1), ("b", 9)]
    events = spark.createDataFrame([("a", 1, "create"), ("a", 3, "delete"), ("a", 2, "change"), ("b", 1, "create")], "path string, seq int, op string")
    assert {r.path: r.op for r in incremental.latest_changes(events, "path", "op", ["seq"]).collect()} == {"a": "delete", "b": "create"}


def test_reload_kind(spark):
    df = spark.createDataFrame([("works/a/1.mit",), ("dictionary/a.json",), ("x",)], "p string")
    assert [r[0] for r in df.select(incremental.reload_kind(F.col("p"))).collect()] == ["recompile", "revalidate", "full"]


def test_stream_folds_to_the_batch_result(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "k string, delta long"
    parts = [[("a", 1), ("b", 1)], [("a", 1), ("b", -1)], [("c", 2)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}")
        stream = spark.readStream.schema(schema).parquet(source)

        def fold(batch, before):
            rows = batch if before is None else batch.unionByName(before.withColumnRenamed("refs", "delta"))
            return rows.groupBy("k").agg(F.sum("delta").alias("refs"))

        incremental.fold_stream(stream, target, fold, f"{tmp_path}/checkpoint").awaitTermination()
    found = {r.k: r.refs for r in spark.read.parquet(f"{target}/batch=2").collect() if r.refs > 0}
    assert found == {"a": 2, "c": 2}
