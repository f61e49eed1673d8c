"""Evidence rows with tamper seals, their links to facts, and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave.functions.numbers import strip
from factweave.functions.text import content_hash, evidence_type


def chunk_evidence(chunks: DataFrame) -> DataFrame:
    """chunk_id with the evidence it stands for; a missing page counts as page 1."""
    kind = evidence_type(F.col("chunk_type"))
    rows = chunks.select(
        "chunk_id", "document_id", F.coalesce(F.nullif("page_number", F.lit(0)), F.lit(1)).alias("page"),
        kind.alias("evidence_type"), strip(F.coalesce("text", F.lit(""))).alias("content"),
    )
    return rows.withColumn("content_hash", content_hash(F.col("content"), F.col("page"), F.col("evidence_type")))


def distinct_evidence(candidates: DataFrame) -> DataFrame:
    """One row per content hash; the first document and chunk win. Copies merge before the shuffle."""
    return candidates.groupBy("content_hash").agg(
        F.min(F.struct("document_id", "chunk_id")).alias("_first"),
        F.min("page").alias("page"), F.min("evidence_type").alias("evidence_type"), F.min("content").alias("content"),
        F.count(F.lit(1)).alias("copies"),
    ).select("content_hash", F.col("_first.document_id").alias("document_id"), F.col("_first.chunk_id").alias("chunk_id"),
             "page", "evidence_type", "content", "copies")


def link_facts(facts: DataFrame, candidates: DataFrame, stored: DataFrame | None = None, role: str = "source") -> DataFrame:
    """(fact_id, content_hash, role) for facts whose chunk is known, minus links stored already."""
    links = facts.select("fact_id", "chunk_id").join(candidates.select("chunk_id", "content_hash"), "chunk_id").select(
        "fact_id", "content_hash", F.lit(role).alias("role"))
    return links if stored is None else links.join(stored.select("fact_id", "content_hash"), ["fact_id", "content_hash"], "left_anti")


def integrity(evidence: DataFrame) -> DataFrame:
    """Adds `intact`: whether the stored seal still fits the content."""
    return evidence.withColumn(
        "intact", content_hash(F.col("content"), F.col("page"), F.col("evidence_type")) == F.col("content_hash"))


def evidence_chain(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every evidence row linked to each fact."""
    return links.join(evidence, "content_hash")
