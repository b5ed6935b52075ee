"""Exact dedup: filters per immutable snapshot screen new digests, positives are checked in exact buckets.

Texts are equal when identical after every character of [\\x20\\x09-\\x0D] is deleted; null
counts as empty. A snapshot holds one row per distinct text and, for each bucket of digests,
one static binary-fuse filter. A new batch is grouped by itself first; its distinct digests
pass the snapshot's filters, and only those that may be known join the exact bucket, where
digest, length and a second hash must agree. Then the bytes are compared: of each such text
the snapshot's best row and the batch's are read again, and only texts equal byte by byte are
one (`same_bytes`). No other text leaves its scan.

Defined cases: no rows give no rows; a null doc_id sorts after all others; rows that repeat
a doc_id with the same text are each returned, count in group_size and share their verdict
(kept_documents returns one of them); of rows of one doc_id whose texts differ in white space
alone and are as long, one text stays; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import fuse_filter
from lexloom.llm.support import LAST, Stage, attach, prepare, row_key, row_tag, with_rows
from lexloom.session import small

#: Distinct digests in one bucket, on average.
BUCKET_KEYS = 4096


def bare_text() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: digest, lengths and a second hash; the text stays behind."""
    return docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), bare_text().alias("_bare"), row_tag(docs).alias("tag")).select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.unhex(F.sha2("_bare", 256)).alias("digest"),
        F.octet_length("_bare").alias("n_bytes"),
        F.xxhash64("_bare").alias("check"),
        "tag",
    )


def grouped(rows: DataFrame) -> DataFrame:
    """The distinct texts of a batch with size and best row; Spark sums per task before the shuffle."""
    order = F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"))
    return rows.groupBy("digest", "n_bytes", "check").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))


class Snapshot:
    """An immutable set of distinct texts with a filter for each bucket of their digests."""

    def __init__(self, groups: DataFrame, stage: Stage, name: str, n_keys: int):
        self.buckets = max(16, n_keys // BUCKET_KEYS)
        self.groups = groups
        self.filters = stage.write(
            self._keyed(groups).groupBy("bucket").applyInPandas(
                lambda pdf: pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse_filter.build(pdf["key"].to_numpy(np.int64).view(np.uint64))]}),
                "bucket int, filter binary",
            ),
            f"{name}-filters",
        )

    def _keyed(self, groups: DataFrame) -> DataFrame:
        return groups.select(F.pmod(F.hash("digest"), F.lit(self.buckets)).alias("bucket"), F.xxhash64("digest").alias("key"), "digest")

    def screen(self, groups: DataFrame) -> DataFrame:
        """Digests of a batch that may be in the snapshot."""

        def probe(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(new):
                return new[["digest"]].iloc[:0]
            return new.loc[fuse_filter.contains(held["filter"].iloc[0], new["key"].to_numpy(np.int64).view(np.uint64)), ["digest"]]

        return self._keyed(groups).groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInPandas(probe, "digest binary")

    def candidates(self, groups: DataFrame) -> DataFrame:
        """Groups of a batch that the exact bucket holds by digest, length and second hash, with the snapshot's best row as held."""
        maybe = groups.join(self.screen(groups), "digest", "left_semi")
        return maybe.join(self.groups.select("digest", "n_bytes", "check", F.col("best").alias("held")), ["digest", "n_bytes", "check"])


def same_bytes(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Digests of candidates whose best rows in batch and snapshot hold the same bytes without white space."""
    rows = candidates.select("digest", F.explode(F.array("best", "held")).alias("row"))
    wanted = rows.select("digest", F.coalesce(F.col("row.id").cast("long"), F.lit(LAST)).alias("key"), F.col("row.tag").alias("tag"))
    texts = docs.select(row_key(docs).alias("key"), row_tag(docs).alias("tag"), "text").join(small(wanted), ["key", "tag"]).select("digest", bare_text().alias("bare"))
    return texts.groupBy("digest").agg((F.min("bare") == F.max("bare")).alias("equal")).filter("equal").select("digest")


def _judged(docs: DataFrame) -> DataFrame:
    """dedup's rows with a tag, the hash of the whole text."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "exact-dedup")
    rows = stage.write(digests(docs).withColumn("fresh", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1), "digests")
    n_rows = rows.count()
    old = stage.write(grouped(rows.filter(~F.col("fresh"))), "old")
    new = stage.write(grouped(rows.filter("fresh")), "new")
    snapshot = Snapshot(old, stage, "snapshot", n_rows)
    candidates = stage.write(snapshot.candidates(new), "candidates")
    known = stage.write(candidates.drop("held").join(same_bytes(docs, candidates), "digest", "left_semi"), "known")
    merged = old.unionByName(known).groupBy("digest", "n_bytes", "check").agg(F.sum("group_size").alias("group_size"), F.min("best").alias("best"))
    unseen = new.join(known.select("digest"), "digest", "left_anti")
    groups = stage.write(merged.unionByName(unseen.select(*merged.columns)).select("digest", "group_size", "best"), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.o")) & (F.col("tag") == F.col("best.tag"))
    return attach(rows.select("doc_id", "n_chars", "tag", "digest"), groups, "digest", "group_size", n_rows).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "tag",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Groups of equal texts over a whole table.

    Half of the rows (by a hash of doc_id) make the first snapshot, the rest come in as a
    batch. Returns doc_id, keep_id, group_size, kept, text_sha256 for every row; of equal
    texts the one with most code points stays, then the smallest doc_id.
    """
    return _judged(docs.select("doc_id", "text")).drop("tag")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each distinct text, the one that stays, with all its columns."""
    kept = _judged(docs.select("doc_id", "text")).filter("kept")
    return with_rows(docs, kept.select(row_key(kept).alias("key"), "tag"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         arg_min(doc_id, {'a': -n_chars, 'b': doc_id}) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
