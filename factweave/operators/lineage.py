"""Audit rows that concern a fact, directly or through its chunk, document or mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def audit_references(audit: DataFrame, id_pattern: str) -> DataFrame:
    """(kind, ref, audit_id): what each audit row names. Ids are read once per row.

    `id_pattern` is the shape of fact ids as they appear inside the meta text.
    """
    target = lambda k: F.struct(F.lit(k[:-3]).alias("kind"), F.get_json_object("target", f"$.{k}").alias("ref"))
    mentions = F.transform(
        F.array_distinct(F.regexp_extract_all("meta", F.lit(f"({id_pattern})"), F.lit(1))),
        lambda m: F.struct(F.lit("mention").alias("kind"), m.alias("ref")),
    )
    named = F.concat(F.array(target("fact_id"), target("chunk_id"), target("document_id")),
                     F.coalesce(mentions, F.array().cast("array<struct<kind:string,ref:string>>")))
    rows = audit.select("audit_id", "at", "action", F.explode(named).alias("r"))
    return rows.select("audit_id", "at", "action", "r.kind", "r.ref").filter(F.col("ref").isNotNull())


_FACT_SIDE = {"fact": "fact_id", "chunk": "chunk_id", "document": "document_id", "mention": "fact_id"}


def lineage(audit: DataFrame, facts: DataFrame, id_pattern: str) -> DataFrame:
    """The audit trail of the given facts, oldest first; pass only the facts asked for."""
    keys = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("ref")) for kind, column in _FACT_SIDE.items()
    ]))
    wanted = facts.select("fact_id", keys.alias("k")).select("fact_id", "k.kind", "k.ref")
    rows = audit_references(audit, id_pattern).join(wanted, ["kind", "ref"])
    return rows.select("fact_id", "audit_id", "at", "action").distinct().orderBy("at", "audit_id")


def lineage_counts(audit: DataFrame, facts: DataFrame, id_pattern: str) -> DataFrame:
    """For every fact, how many audit rows name it, its chunk, its document, or mention it.

    References are counted before they meet the facts, so a busy document costs one row.
    """
    counts = audit_references(audit, id_pattern).groupBy("kind", "ref").agg(F.countDistinct("audit_id").alias("n"))
    result = facts.select("fact_id", "chunk_id", "document_id")
    for kind, column in _FACT_SIDE.items():
        mine = counts.filter(F.col("kind") == kind).select(F.col("ref").alias(column), F.col("n").alias(f"n_{kind}"))
        result = result.join(mine, column, "left").withColumn(f"n_{kind}", F.coalesce(f"n_{kind}", F.lit(0)))
    return result.select("fact_id", *[f"n_{k}" for k in _FACT_SIDE])


def recent(audit: DataFrame, limit: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("at"), F.desc("audit_id")).limit(limit)
