"""Exact deduplication against a persistent digest index.

The index is a Parquet table of SHA-256 digests, bucketed and sorted by digest.
A batch is reduced to one row per digest (map-side first), sort-merge
anti-joined with the index, and what is new is appended; a text that the index
already holds is dropped from the batch, whichever batch brought it.

Defined results: a null text counts as empty; an empty batch appends nothing;
of equal texts the row with the largest id stays (null ids come last); rows
that repeat both id and text carry the same decision; other columns, whatever
their names, are never read. All expressions are native.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_by_key, fresh_path, materialize, read, shuffle_partitions, text_key


class DigestIndex:
    """The digests seen so far and the id that stays for each, kept at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.table = "digest_index_" + hashlib.sha1(path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def add(self, stats: DataFrame) -> None:
        """Append the digests of ``stats`` that the index does not hold yet (a rerun appends nothing)."""
        new = stats.select("digest", "keep_id").hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)


def dedup_decisions(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size (rows of this batch
    with that text) and kept. ``index`` is updated."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("digest")), "digests")
    # ids first, so that one digest's rows are counted in many tasks
    per_id = rows.groupBy("digest", "id").agg(F.count("*").alias("n"))
    stats = materialize(per_id.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")),
                        "digest-groups")
    index.add(stats)
    stay = materialize(stats.select("digest", "group_size").hint("merge").join(index.read(), "digest"), "digest-kept")
    out = attach_by_key(rows, stay, "digest", "group_size", rows.count())
    return out.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def new_index(docs: DataFrame, id_col: str = "doc_id") -> DigestIndex:
    """An empty index in a new shared folder, with a bucket for each shuffle partition."""
    spark = docs.sparkSession
    return DigestIndex(spark, fresh_path(spark, "digest-index"), shuffle_partitions(spark),
                       docs.schema[id_col].dataType.simpleString())


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (rows that repeat id and text stay once).

    Only ids and digests are compared. A row whose (id, text) appears once and
    stays is passed on as read; the dropped and the repeated ones are found by
    anti- and semi-joins with their digests."""
    decided = materialize(dedup_decisions(docs, index or new_index(docs, id_col), id_col, text_col), "dedup")
    twice = decided.filter("kept").groupBy(F.col(id_col).alias("__id"), F.col("digest").alias("__digest")).count()
    again = materialize(twice.filter("count > 1").drop("count"), "repeated")
    out = materialize(decided.filter("not kept").select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest"))
                      .unionByName(again).distinct(), "dropped")
    key = text_key(text_col)
    same = lambda other: docs[id_col].eqNullSafe(other["__id"]) & (key == other["__digest"])
    once = docs.join(out, same(out), "left_anti")
    if again.isEmpty():
        return once
    rest = docs.join(again, same(again), "left_semi").withColumn("__digest", key)
    return once.unionByName(rest.dropDuplicates([id_col, "__digest"]).drop("__digest"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    d = dedup_decisions(docs, new_index(docs))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
