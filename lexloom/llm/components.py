"""Connected components of an edge table by contraction, all in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.support import Stage, attach


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges and each one's component's smallest node: roots are hooked to smaller ones beside them, paths made short."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return nodes, nodes[root]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    nodes, label = smallest(*(np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*ends, strict=True))) if ends else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])


def solved(edges: DataFrame) -> DataFrame:
    """As components(), in one task: for edges that its memory holds."""
    return edges.select("a", "b").filter("a <> b").coalesce(1).mapInArrow(_solve, "node long, label long")


def components(edges: DataFrame, stage: Stage, name: str, at_once: int = 0) -> DataFrame:
    """node and its component's smallest node (label), for all nodes of edges (a, b).

    Nodes are ranked by a hash, so the order of ids plays no part. Each round sends every node
    to the first in rank of its neighbours and itself, and keeps the edges between what the ends
    were sent to. Stars vanish in two rounds; of any other component, chains in the order of ids
    among them, about half of the nodes go, so rounds number the logarithm of the largest component.
    As soon as at most at_once edges are left, one task's Python solves them.
    """

    def ranked(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("to"))

    edges = stage.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    empty = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    rounds: list[DataFrame] = []
    while n_edges := edges.count():
        k, n_rows = len(rounds), 2 * n_edges
        if n_edges <= at_once:
            rounds.append(stage.write(solved(edges).withColumnRenamed("label", "to"), f"{name}-rest"))
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        first = both.groupBy("node").agg(F.min(ranked("to")).alias("first"), F.count("*").alias("degree"))
        sent = stage.write(first.withColumn("to", F.col("node")).select("node", F.least("first", ranked("to"))["to"].alias("to"), "degree"), f"{name}-sent-{k}")
        rounds.append(sent)
        to_a = sent.select(F.col("node").alias("a"), F.col("to").alias("ta"), "degree")
        to_b = sent.select(F.col("node").alias("b"), F.col("to").alias("tb"), "degree")
        half = attach(edges, to_a, "a", "degree", n_rows).select("b", "ta")
        both_ends = attach(half, to_b, "b", "degree", n_rows).filter("ta <> tb")
        edges = stage.write(both_ends.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-edges-{k + 1}")
    if not rounds:
        return empty
    # the last rounds' tables are small, so they are put together first: where each round's nodes end up
    ends = rounds[-1].select("node", F.col("to").alias("label"))
    for sent in reversed(rounds[:-1]):
        further = sent.select("node", "to").join(ends.select(F.col("node").alias("to"), "label"), "to", "left")
        ends = further.select("node", F.coalesce("label", "to").alias("label"))
    ends = stage.write(ends, f"{name}-ends")
    smallest = stage.write(ends.groupBy("label").agg(F.min("node").alias("least"), F.count("*").alias("held")), f"{name}-least")
    return attach(ends, smallest, "label", "held", ends.count()).select("node", F.col("least").alias("label"))
