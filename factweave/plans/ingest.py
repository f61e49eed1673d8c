"""From extracted claims to normalised facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.names import canonical_attribute, clean_entity
from factweave.functions.numbers import with_number
from factweave.functions.periods import normalized_period
from factweave.operators.entities import best_canonical, canonical_names
from factweave.operators.semantic import nearest_names
from factweave.session import write_through


def normalize_facts(extracted: DataFrame) -> DataFrame:
    """Adds entity_canon, attribute_canon, norm_value, norm_unit; currency and unit fall back to the stated ones."""
    rows = with_number(extracted, "raw_value", "value_number", "_n")
    return rows.withColumns(
        {
            "entity_canon": F.when(F.col("entity") != "", clean_entity(F.col("entity"))),
            "attribute_canon": canonical_attribute(F.col("attribute")),
            "norm_value": F.col("_n.norm_value"),
            "norm_unit": F.coalesce("_n.norm_unit", "unit"),
            "currency": F.coalesce("_n.currency", "currency"),
            "period": normalized_period(F.col("period"), F.col("raw_value")),
        }
    ).drop("_n")


def resolve_entities(names: DataFrame, aliases: DataFrame, canonicals: DataFrame, ratio: float = V.ENTITY_RATIO) -> DataFrame:
    """(name, canonical, step) for distinct cleaned names: the stored alias, else the best stored
    canonical name above the ratio, else a canonical name among the new ones.

    aliases: alias (lower case), canonical. canonicals: name. Rows of the last two steps are the
    aliases to add: see `new_aliases`.
    """
    stored = aliases.select(F.col("alias").alias("_alias"), F.col("canonical"))
    known = names.join(stored, F.lower("name") == F.col("_alias")).groupBy("name").agg(F.min("canonical").alias("canonical"))
    rest = write_through(names.join(known, "name", "left_anti").select("name").distinct(), "open-names")
    matched = write_through(best_canonical(rest, canonicals, ratio), "matched-names")
    fresh = canonical_names(matched.filter(F.col("canonical").isNull()).select("name"), ratio)
    step = lambda df, label: df.select("name", "canonical", F.lit(label).alias("step"))
    return step(known, "alias").unionByName(step(matched.filter(F.col("canonical").isNotNull()), "fuzzy")).unionByName(step(fresh, "new"))


def new_aliases(resolved: DataFrame) -> DataFrame:
    """What the alias table learns from a run."""
    return resolved.filter(F.col("step") != "alias").select(F.lower("name").alias("alias"), "canonical")


def normalization_stage(
    extracted: DataFrame, aliases: DataFrame, canonicals: DataFrame, vectors: DataFrame | None = None,
    metrics: DataFrame | None = None, namespace: DataFrame | None = None, threshold: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Normalised facts with resolved entities and attributes, and the aliases to add.

    vectors: attribute_canon, embedding of attributes; metrics and namespace: name, embedding.
    An attribute with a vector takes the nearest name at or above the threshold.
    """
    rows = normalize_facts(extracted)
    resolved = write_through(resolve_entities(rows.filter(F.col("entity_canon").isNotNull()).select(F.col("entity_canon").alias("name")).distinct(),
                                              aliases, canonicals), "resolved-names")
    facts = rows.join(resolved.select(F.col("name").alias("entity_canon"), F.col("canonical").alias("_entity")), "entity_canon", "left").withColumn(
        "entity_canon", F.coalesce("_entity", "entity_canon")).drop("_entity")
    if vectors is not None:
        nearest = nearest_names(vectors, metrics, namespace, threshold, "attribute_canon").select("attribute_canon", F.col("name").alias("_attribute"))
        facts = facts.join(nearest, "attribute_canon", "left").withColumn("attribute_canon", F.coalesce("_attribute", "attribute_canon")).drop("_attribute")
    return facts, new_aliases(resolved)
