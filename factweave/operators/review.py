"""The review queue: filling it, reading it, searching it and counting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import falsy_confidence


def review_items(anomalies: DataFrame, facts: DataFrame, relations: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """New pending items from anomalies, low confidence and contradictions.

    One item per fact and reason; items already pending are not added again.
    """
    none = F.lit(None).cast("string")
    odd = anomalies.filter(F.col("fact_id").isNotNull()).select(
        "fact_id", none.alias("relation_id"), F.concat(F.lit("anomaly:"), F.col("anomaly_type")).alias("reason"),
        F.col("description").alias("decision"),
    )
    confidence = falsy_confidence(F.col("confidence"))
    unsure = facts.filter(confidence < V.LOW_CONFIDENCE).select(
        "fact_id", none.alias("relation_id"), F.lit("low_confidence").alias("reason"),
        F.concat(F.lit("Extraction confidence "), F.format_string("%.2f", confidence), F.lit(" below 0.5 threshold")).alias("decision"),
    )
    opposed = relations.filter(F.col("relation") == "contradicts").select(
        F.col("fact_a").alias("fact_id"), "relation_id", F.lit("contradiction").alias("reason"),
        (F.col("explanation") if "explanation" in relations.columns else F.lit("Cross-document contradiction detected")).alias("decision"),
    )
    found = odd.unionByName(unsure).unionByName(opposed)
    items = found.groupBy("fact_id", "reason").agg(
        F.min(F.struct(F.coalesce("relation_id", F.lit("")).alias("relation_id"), "decision")).alias("first")
    ).select(
        F.sha2(F.concat_ws("|", "fact_id", "reason"), 256).alias("review_id"), "fact_id",
        F.nullif("first.relation_id", F.lit("")).alias("relation_id"), "reason", F.lit("pending").alias("status"), "first.decision",
    )
    if pending is None:
        return items
    waiting = pending.filter(F.col("status") == "pending").select("fact_id", "reason")
    return items.join(waiting, ["fact_id", "reason"], "left_anti")


def enriched_queue(queue: DataFrame, facts: DataFrame, documents: DataFrame, chunks: DataFrame, status: str = "pending") -> DataFrame:
    """Items with their fact, file name and page; an empty status keeps every item."""
    if status:
        queue = queue.filter(F.col("status") == status)
    details = facts.select(
        "fact_id", "document_id", "chunk_id", "entity_canon", "attribute_canon", "raw_value",
        F.col("confidence").alias("fact_confidence"), "page_number",
    )
    return (
        queue.join(details, "fact_id", "left")
        .join(documents.select("document_id", "filename"), "document_id", "left")
        .join(chunks.select("chunk_id", F.col("page_number").alias("chunk_page")), "chunk_id", "left")
        .withColumn("page", F.coalesce("page_number", "chunk_page"))
        .drop("page_number", "chunk_page")
    )


def anomalies_of_queue(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("reason").startswith("anomaly:"))


def search_queue(enriched: DataFrame, text: str) -> DataFrame:
    """Case-insensitive search in entity, attribute, reason, file name and decision."""
    wanted = text.strip().lower()
    if not wanted:
        return enriched
    test = F.lit(False)
    for c in ["entity_canon", "attribute_canon", "reason", "filename", "decision"]:
        test = test | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    return enriched.filter(test)


def stats(queue: DataFrame) -> DataFrame:
    """Items per status, zero where there are none, and the total."""
    spark: SparkSession = queue.sparkSession
    statuses = spark.createDataFrame([(s,) for s in V.REVIEW_STATUSES], "status string")
    counted = queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    filled = statuses.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_items"))
    return filled.unionByName(
        counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items")).select(F.lit("total").alias("status"), "n_items")
    )
