"""Document intake: validation, content identity, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Uploaded files as rows: path, content (binary), length. Spark itself skips files without any bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", "length")


def accepted(files: DataFrame, content: str = "content", magic: str = V.PDF_MAGIC, limit: int = V.MAX_UPLOAD_BYTES) -> DataFrame:
    """Every file with its verdict, content hash and storage key; rejected files keep a reason."""
    data = F.col(content).cast("binary")
    size = F.octet_length(data)
    reason = (
        F.when(data.isNull() | (size == 0), "Uploaded file is empty")
        .when(F.lit(bool(magic)) & ~F.startswith(data, F.lit(magic).cast("binary")), "Uploaded file is not a valid PDF document (missing %PDF header)")
        .when(size > limit, f"File exceeds maximum allowed size of {limit // (1024 * 1024)}MB")
    )
    sha = F.sha2(data, 256)
    return files.withColumns({"size_bytes": size.cast("long"), "reject_reason": reason}).withColumns(
        {
            "sha256": F.when(F.col("reject_reason").isNull(), sha),
            "storage_key": F.when(F.col("reject_reason").isNull(), F.concat(F.lit("docs/"), sha, F.lit(".pdf"))),
        }
    )


def first_by_hash(documents: DataFrame, key: str, sha: str = "sha256") -> DataFrame:
    """(sha256, first key, number of copies); copies are merged before the shuffle."""
    return documents.groupBy(sha).agg(F.min(key).alias(f"first_{key}"), F.count(F.lit(1)).alias("copies"))


def with_original(documents: DataFrame, key: str, sha: str = "sha256") -> DataFrame:
    """Each document with the first document of the same content; null duplicate_of for originals."""
    first = first_by_hash(documents, key, sha).filter(F.col("copies") > 1).select(sha, F.col(f"first_{key}").alias("_first"))
    return documents.join(first, sha, "left").withColumn(
        "duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))
    ).drop("_first")


def page_route(text: Column, images: Column | None = None, failed: Column | None = None) -> Column:
    """text, scan, empty or error, by the number of characters on the page."""
    chars = F.length(strip(F.coalesce(text, F.lit(""))))
    pictures = images if images is not None else F.lit(0)
    broken = failed if failed is not None else F.lit(False)
    return (
        F.when(broken, "error")
        .when(chars >= V.SCAN_CHARS, "text")
        .when((chars > 0) | (pictures > 0), "scan")
        .otherwise("empty")
    )
