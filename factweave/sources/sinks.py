"""Writing tables: appends, keyed upserts, insert-if-absent, keyed tables, CSV and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.session import write_through

#: rows of a page in a keyed table: what a lookup reads at least
PAGE_ROWS = 1000


def insert_absent(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stored rows plus the first incoming row of every key not stored yet."""
    columns = [c for c in stored.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(*key, "_r.*")
    return stored.unionByName(first.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str, keep_old: list[str], overwrite: list[str]) -> DataFrame:
    """Keyed upsert of a batch, as if its rows came one by one in `order`.

    `keep_old` columns take the last value that is not null, else the stored one;
    `overwrite` columns take the last value whatever it is.
    """
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in keep_old]
    last += [F.max_by(F.struct(F.col(c).alias("v")), order).alias(f"_{c}") for c in overwrite]
    batch = incoming.groupBy(*key).agg(*last)
    joined = stored.join(batch, key, "full_outer")
    for c in keep_old:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
    for c in overwrite:
        joined = joined.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)))
    return joined.select(*stored.columns)


class KeyedTable:
    """A table in folders by key hash, rows sorted by key inside, with bloom filters on the key.

    An upsert reads and writes the folders of its keys only; the files of the others stay as
    they are. A lookup lists the folder of its key and skips row groups and pages by bloom filter
    and statistics, so it doesn't scan.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, mode: str = "errorifexists") -> None:
        """Rows of other folders are left alone by mode `overwrite`."""
        placed = rows.withColumn("bucket", self._bucket(F.col(self.key))).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        (placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
         .option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("bucket").parquet(self.path))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def upsert(self, incoming: DataFrame, order: str, keep_old: list[str], overwrite: list[str]) -> None:
        """`upsert` of a batch, folder by folder; the result is written aside before it replaces what was read."""
        batch = incoming.withColumn("bucket", self._bucket(F.col(self.key)))
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            stored = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
            self.write(write_through(upsert(stored, incoming, [self.key], order, keep_old, overwrite), "upsert"), "overwrite")

    def lookup(self, *keys) -> DataFrame:
        """The rows of the given keys."""
        stored = self.spark.read.parquet(self.path)
        folders = [self._bucket(F.lit(k).cast(stored.schema[self.key].dataType)) for k in keys]
        return stored.filter(F.col("bucket").isin(*folders) & F.col(self.key).isin(*keys)).drop("bucket")


def compatibility_views(document_pages: DataFrame, document_chunks: DataFrame, prefix: str = "") -> None:
    """The older names of pages and chunks as views `pages` and `chunks`, with page_number as page."""
    view = lambda df, columns: df.select("id", "document_id", F.col("page_number").alias("page"), *[c for c in columns if c in df.columns])
    view(document_pages, ["width", "height", "png_key", "route", "created_at"]).createOrReplaceTempView(f"{prefix}pages")
    view(document_chunks, ["chunk_type", "text", "bbox", "heading", "ocr_provider", "created_at"]).createOrReplaceTempView(f"{prefix}chunks")


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Parquet sink for documents, facts, relations, findings and calculations."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    """Every field quoted, quotes doubled, missing values empty."""
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias((labels or {}).get(c, c)) for c in df.columns])
    named.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def audit_rows(df: DataFrame, action: str, target: Column, meta: Column, keep: list[str] | None = None, actor: str = "system") -> DataFrame:
    """Audit rows for an event per row of `df`, with the columns `keep` of the row beside them."""
    return df.select(
        F.current_timestamp().alias("at"), F.lit(actor).alias("actor"), F.lit(action).alias("action"),
        F.to_json(target).alias("target"), F.to_json(meta).alias("meta"), *(keep or []),
    ).withColumn("day", F.to_date("at"))


def append_audit(rows: DataFrame, path: str) -> None:
    """The audit log is append-only and partitioned by day."""
    rows.write.mode("append").partitionBy("day").parquet(path)
