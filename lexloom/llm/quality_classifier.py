"""Quality classifier: a linear-chain CRF labels every line, its marginals weighted by length score the document.

Training takes labelled rows outside the held-out third, at most TRAIN_DOCS of them by the
order of a hash of doc_id (the bound on what the driver fits on); a document's label stands
for all its lines. Features are counts of kinds of bytes and words in a line and in the lines
beside it; labels, lang, source and doc_id are never among them. The model is a few kB and
goes to the executors with the task.

Defined cases: null and empty texts are one empty line and get that line's score; with no
labels of both kinds every score is 0.5; unlabelled rows, repeated rows and null ids are
scored like any others; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.crf import ChainCRF, fit
from lexloom.llm.lines import line_features
from lexloom.llm.support import prepare
from lexloom.llm.words import slices, strings

TRAIN_DOCS = 4000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> ChainCRF | None:
    """The CRF of a bounded sample of labelled rows that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    # min over repeats: a row labelled both ways counts as bad
    sample = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs).groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            x, rows, _ = line_features(*strings(batch.column(2)))
            x = x.astype(np.float32)
            blobs = [x[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["doc_id", "quality", "lines"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(features, "doc_id long, quality int, lines binary").collect()
    if {r.quality for r in found} != {0, 1}:
        return None
    found.sort(key=lambda r: (r.doc_id, r.lines))
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    parts = [np.frombuffer(r.lines, np.float32).reshape(-1, width) for r in found]
    sizes = [len(p) for p in parts]
    return fit(np.concatenate(parts).astype(np.float64), np.repeat([r.quality for r in found], sizes), np.r_[0, np.cumsum(sizes)])


def scored(docs: DataFrame, model: ChainCRF | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            score = np.full(batch.num_rows, 0.5)
            if model is not None and batch.num_rows:
                x, rows, length = line_features(*strings(batch.column(2)))
                good = model.marginals(x, rows)[:, 1]
                weight = length + 1.0
                score = np.add.reduceat(good * weight, rows[:-1]) / np.add.reduceat(weight, rows[:-1])
                score = np.clip(score, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    prepare(docs.sparkSession)
    return scored(docs, train(docs, labels, max_docs))


def accepted(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs that the classifier predicts good, with all their columns; texts pass through one map."""
    prepare(docs.sparkSession)
    model = train(docs, labels, max_docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            if model is not None and batch.num_rows:
                x, rows, length = line_features(*strings(batch.column(at)))
                good, weight = model.marginals(x, rows)[:, 1], length + 1.0
                keep = np.add.reduceat(good * weight, rows[:-1]) >= 0.5 * np.add.reduceat(weight, rows[:-1])
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
