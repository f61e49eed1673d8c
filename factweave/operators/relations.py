"""Reading stored relations: expansion, counterparts, summaries and the entity matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V
from factweave.operators.counting import relation_counts
from factweave.operators.pairs import directed


#: columns of both facts (a_*, b_*) that relations may still carry from their pairs; then no fact is looked up
CARRIED = ["raw_value", "norm_value", "period", "scope", "document_id"]


def _carries(relations: DataFrame) -> bool:
    return {"entity_canon", "attribute_canon", *[f"{s}_{c}" for s in "ab" for c in CARRIED]} <= set(relations.columns)


def expand_relations(
    relations: DataFrame,
    facts: DataFrame,
    documents: DataFrame,
    relation: str | None = None,
    document_id: str | None = None,
) -> DataFrame:
    """Relations with both facts and both file names, optionally of one kind or one document."""
    if relation is not None:
        relations = relations.filter(F.col("relation") == relation)
    if _carries(relations):
        return _expand_carried(relations, documents, document_id)
    described = facts.join(documents.select("document_id", "filename"), "document_id")

    def end(side: str) -> DataFrame:
        return described.select(
            F.col("fact_id").alias(f"fact_{side}"),
            F.col("entity_canon").alias(f"{side}_entity"),
            F.col("attribute_canon").alias(f"{side}_attribute"),
            F.col("raw_value").alias(f"{side}_value"),
            F.col("norm_value").alias(f"{side}_norm_value"),
            F.col("document_id").alias(f"{side}_document_id"),
            F.col("filename").alias(f"{side}_filename"),
        )

    joined = relations.join(end("a"), "fact_a").join(end("b"), "fact_b")
    if document_id is not None:
        joined = joined.filter((F.col("a_document_id") == document_id) | (F.col("b_document_id") == document_id))
    return joined


def _expand_carried(relations: DataFrame, documents: DataFrame, document_id: str | None) -> DataFrame:
    if document_id is not None:
        relations = relations.filter((F.col("a_document_id") == document_id) | (F.col("b_document_id") == document_id))
    own = [c for c in relations.columns if c not in ("entity_canon", "attribute_canon") and c[2:] not in CARRIED]
    side = lambda s: [F.col("entity_canon").alias(f"{s}_entity"), F.col("attribute_canon").alias(f"{s}_attribute"), F.col(f"{s}_raw_value").alias(f"{s}_value"),
                      f"{s}_norm_value", f"{s}_document_id"]
    rows = relations.select(*own, *side("a"), *side("b"))
    for s in "ab":
        rows = rows.join(documents.select(F.col("document_id").alias(f"{s}_document_id"), F.col("filename").alias(f"{s}_filename")), f"{s}_document_id")
    return rows


def counterparts(relations: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """For every fact, the facts it is related to, one row each."""
    if _carries(relations):
        own = [c for c in relations.columns if c not in ("fact_a", "fact_b", "entity_canon", "attribute_canon") and c[2:] not in CARRIED]
        end = lambda a, b: F.struct(
            F.col(f"fact_{a}").alias("fact_id"), F.col(f"fact_{b}").alias("counterpart_id"), F.col(f"{b}_raw_value").alias("counterpart_value"),
            F.col(f"{b}_period").alias("counterpart_period"), F.col(f"{b}_scope").alias("counterpart_scope"), F.col(f"{b}_document_id").alias("_document"))
        ends = relations.select(*own, F.explode(F.array(end("a", "b"), end("b", "a"))).alias("_end")).select(*own, "_end.*")
        return ends.join(documents.select(F.col("document_id").alias("_document"), F.col("filename").alias("counterpart_filename")), "_document").drop("_document")
    other = facts.join(documents.select("document_id", "filename"), "document_id").select(
        F.col("fact_id").alias("counterpart_id"),
        F.col("raw_value").alias("counterpart_value"),
        F.col("period").alias("counterpart_period"),
        F.col("scope").alias("counterpart_scope"),
        F.col("filename").alias("counterpart_filename"),
    )
    return directed(relations).join(other, "counterpart_id")


def relation_summary(relations: DataFrame) -> DataFrame:
    """fact_id with the sorted distinct relations it takes part in."""
    # distinct first: a set that is collected can't be hashed before the shuffle and would sort every relation
    kinds = directed(relations.select("fact_a", "fact_b", "relation")).select("fact_id", "relation").distinct()
    return kinds.groupBy("fact_id").agg(F.array_sort(F.collect_set("relation")).alias("relations_summary"))


def with_relation_summary(facts: DataFrame, relations: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return facts.join(relation_summary(relations), "fact_id", "left").withColumn(
        "relations_summary", F.coalesce("relations_summary", empty)
    )


def badge_rank(relation: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(V.RELATIONS, 1))):
        rank = F.when(relation == name, position).otherwise(rank)
    return rank


def badge_of_rank(rank: Column) -> Column:
    name = F.lit(None).cast("string")
    for position, value in reversed(list(enumerate(V.RELATIONS, 1))):
        name = F.when(rank == position, F.lit(value)).otherwise(name)
    return name


def entity_matrix(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """One cell per entity and attribute: number of facts and the strongest badge.

    The id list of a cell can be as long as the fact table, so it stays a link table
    (`facts` keyed by the cell); the cell itself carries bounded values only.
    """
    by = ["entity_canon", "attribute_canon"]
    known = facts.dropna(subset=by)
    ranks = directed(relations).groupBy("fact_id").agg(F.min(badge_rank(F.col("relation"))).alias("rank"))
    return (
        known.select("fact_id", *by)
        .join(ranks, "fact_id", "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_facts"), F.min("fact_id").alias("first_fact_id"), F.min("rank").alias("rank"))
        .withColumn("badge", badge_of_rank(F.col("rank")))
        .drop("rank")
    )


def matrix_of_facts(facts: DataFrame) -> DataFrame:
    """The matrix with pair counts per relation, straight from facts; no pair is listed."""
    by = ["entity_canon", "attribute_canon"]
    counts = relation_counts(facts, by)
    wide = counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("relation") == r, F.col("n_pairs"))), F.lit(0)).alias(f"n_{r}") for r in V.RELATIONS],
        F.min(badge_rank(F.col("relation"))).alias("rank"),
    )
    cells = facts.dropna(subset=by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_facts")).join(wide, by, "left")
    filled = cells.na.fill(0, [f"n_{r}" for r in V.RELATIONS])
    return filled.withColumn("badge", badge_of_rank(F.col("rank"))).drop("rank")
