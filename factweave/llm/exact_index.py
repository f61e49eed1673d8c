"""Exact dedup with a persistent digest index.

Two texts are equal when they are identical after white space (space, U+0009 to U+000D) is
deleted; a null text counts as empty. The index is a table bucketed and sorted by digest. A
batch is reduced to one entry per digest, the entries meet the index in a sort-merge anti join
(the index side is neither shuffled nor sorted again), and the unknown ones are appended.

Defined results: the row with the most code points in its original text stays, then the one
with the smallest doc_id (null ids last), then any one of fully equal rows; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.common import numbered
from factweave.session import new_path, write_through

WHITE = " \t\n\x0b\x0c\r"
ENTRY = "digest binary, keep_id bigint, keep_row bigint, group_size bigint"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    bare = F.coalesce(text, F.lit(""))
    for c in WHITE:  # on bytes, unlike a pattern or translate()
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.unhex(F.sha2(bare, 256))


def digests(rows: DataFrame, doc_id: Column, text: Column, row_no: Column) -> DataFrame:
    return rows.select(
        doc_id.cast("bigint").alias("doc_id"), row_no.alias("row_no"), digest_of(text).alias("digest"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("n_chars"))


def entries_of(digested: DataFrame) -> DataFrame:
    """One entry per digest: the row that stays and the number of rows."""
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    return digested.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), "group_size")


class DigestIndex:
    """The digests of everything seen so far, kept as a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, table: str | None = None, buckets: int | None = None) -> DigestIndex:
        """Creates the index, or registers the one whose files lie at `path`.

        `buckets` is fixed when an index is made; at the number of shuffle partitions a batch
        is grouped, joined and written in one and the same partitioning.
        """
        path = path or new_path(spark, "digest-index")
        table = table or f"digest_index_{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            spark.sql(f"CREATE TABLE {table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        return cls(spark, table, path, buckets)

    def unknown(self, entries: DataFrame) -> DataFrame:
        """The entries whose digest the index does not hold."""
        return entries.join(self.spark.table(self.table).select("digest").hint("merge"), "digest", "left_anti")

    def add(self, digested: DataFrame) -> DataFrame:
        """Appends what is new in a batch of digested rows; returns the appended entries."""
        fresh = write_through(self.unknown(entries_of(digested)), "digest-entries")
        (fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))
        self.spark.catalog.refreshTable(self.table)
        return fresh

    def drop(self) -> None:
        """Forgets the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def decisions(digested: DataFrame, index: DigestIndex) -> DataFrame:
    """What becomes of each row of a batch: (doc_id, row_no, keep_id, group_size, kept, text_sha256).

    A row whose text came in an earlier batch is not kept; it has no keep_id. The shuffled
    batch side of the join is split by adaptive execution where one digest is hot.
    """
    fresh = index.add(digested)
    joined = digested.join(fresh.hint("merge"), "digest", "left")
    return joined.select(
        "doc_id", "row_no", "keep_id", "group_size", F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def duplicate_report(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """A row per document with the document that stands for its text, dropped ones too."""
    index = index or DigestIndex.open(docs.sparkSession)
    rows = write_through(digests(docs, F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()), "digests")
    return decisions(rows, index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    index = index or DigestIndex.open(docs.sparkSession)
    rows = numbered(docs, "exact-rows")
    found = decisions(write_through(digests(rows, F.col("record.doc_id"), F.col("record.text"), F.col("row_no")), "digests"), index)
    return rows.join(found.filter("kept").select("row_no"), "row_no", "left_semi").select("record.*")
