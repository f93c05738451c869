"""Exact deduplication over a persistent digest index.

The index is a Parquet table of (digest, keep_id, group_size), bucketed and sorted by
digest; it is only ever appended to.  New rows are digested once (JVM ``sha2``) and
reduced to one row per digest.  A sort-merge anti-join on the bucketing key finds the
digests that the index lacks, which are appended with their kept row; for digests that
it has, a sort-merge join gives the row kept before, and the number of new copies is
appended.  The index side of both joins is read by buckets and not shuffled; where
several appends left several files a bucket, Spark sorts a bucket again when it reads it.

Skew: copies are counted with a map-side partial aggregate, so a digest that a
third of all rows carry sends one row per map task.  To tell rows what their
group decided, digests that hold at least 1/1000 of all rows go by broadcast (by
counting there are at most 1000 of them); the rest go by a shuffled join, where no
key can hold more than a thousandth of the rows.

Defined cases: null text is empty text; of rows with equal digest the largest
doc_id stays, a null doc_id ranks lowest, and of rows with the same doc_id exactly
one stays (the last in the written digest table); of digests in the index the row kept
then stays and all new ones go; an empty table gives an empty result; only ``doc_id`` and
``text`` are read, and ``survivors`` keeps other columns whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, attach, drop_table, filter_by, scratch, text_of, unused, written


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normalised text: one narrow pass over the text."""
    return docs.select("doc_id", F.sha2(ascii_lower(text_of()).cast("binary"), 256).alias("digest"))


class DigestIndex:
    """A bucketed, sorted table of digests at ``path``; open it again with the same path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + uuid.uuid4().hex
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def close(self) -> None:
        """Forgets the table's name; its files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        """All appended rows."""
        return self.spark.table(self.name)

    def digests(self) -> DataFrame:
        """One row a digest: the row kept and the copies counted so far."""
        return self.table().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def unseen(self, grouped: DataFrame) -> DataFrame:
        """Groups whose digest the index lacks."""
        return grouped.hint("merge").join(self.table().select("digest"), "digest", "left_anti")

    def seen(self, grouped: DataFrame) -> DataFrame:
        """Groups whose digest the index has: digest, keep_id of the row kept before,
        copies among the new rows and in all."""
        known = self.digests().withColumnRenamed("group_size", "before")
        met = grouped.select("digest", F.col("group_size").alias("copies")).hint("merge").join(known, "digest")
        return met.select("digest", "keep_id", "copies", (F.col("copies") + F.col("before")).alias("group_size"))

    def append(self, grouped: DataFrame) -> None:
        (
            grouped.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicates ``docs`` against the index and within itself, appends what is
        new, and returns one row per input row: rid, doc_id, digest, keep_id (of the row
        that stays, perhaps one of an earlier batch), group_size (copies in all batches),
        seen (digest was in the index before), kept."""
        rows = written(digests(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "digest"), "digests")
        best = F.max(F.struct(F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid")))
        grouped = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        grouped = written(grouped.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size"), "digest-groups")
        fresh = written(self.unseen(grouped), "fresh-digests")
        old = written(self.seen(grouped), "seen-digests")
        self.append(fresh)
        if not old.isEmpty():
            self.append(old.select("digest", "keep_id", F.col("copies").alias("group_size")))
        new = fresh.select("digest", "keep_id", "keep_rid", "group_size", F.col("group_size").alias("copies"), F.lit(False).alias("seen"))
        again = old.select("digest", "keep_id", F.lit(None).cast("long").alias("keep_rid"), "group_size", "copies", F.lit(True).alias("seen"))
        out = attach(rows, written(new.unionByName(again), "digest-verdicts"), "digest", "copies")
        for done in (grouped, fresh, old):
            drop_table(done)
        kept = F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False))
        return out.select("rid", "doc_id", "digest", "keep_id", "group_size", "seen", kept.alias("kept"))


def dedup(docs: DataFrame, index_path: str | None = None, buckets: int | None = None) -> DataFrame:
    """``DigestIndex.add`` on the index at ``index_path`` (a new one in the shared
    folder by default)."""
    spark = docs.sparkSession
    n = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = DigestIndex(spark, index_path or scratch(spark, "digest-index"), n)
    out = index.add(docs)
    index.close()
    return out


def survivors(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.  Rows that repeat
    both doc_id and digest are one document: one of them stays."""
    name = unused("digest", docs)
    verdict = written(dedup(docs, index_path).select("doc_id", F.col("digest").alias(name), "kept"), "verdicts")
    each = written(verdict.groupBy("doc_id", name).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")), "document-verdicts")
    dropped = written(each.filter("not kept").select("doc_id", name), "dropped")
    repeated = written(each.filter("kept and copies > 1").select("doc_id", name), "repeated")
    digest = F.sha2(ascii_lower(text_of()).cast("binary"), 256)
    out = filter_by(docs.withColumn(name, digest), dropped, "left_anti")
    if not repeated.isEmpty():
        out = filter_by(out, repeated, "left_anti").unionByName(filter_by(out, repeated, "left_semi").dropDuplicates(["doc_id", name]))
    return out.drop(name)
