"""Entity and attribute names in their canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip


def title_case(text: Column) -> Column:
    """Upper case after every character that is no letter."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def _spaced(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def _without(pattern: str):
    def shorten(text: Column) -> Column:
        shorter = strip(F.regexp_replace(text, pattern, " "))
        return F.when(F.length(shorter) >= V.SHORTEST_NAME, shorter).otherwise(text)

    return shorten


def clean_entity(name: Column) -> Column:
    """Known acronyms spelled out; otherwise punctuation and legal suffixes removed, title case.

    A suffix goes only if at least two characters of the name remain. The steps run over a
    one-element array so that each step names its input once.
    """
    lowered = strip(F.lower(name))
    acronyms = F.create_map(*[x for k, v in V.ACRONYMS.items() for x in (F.lit(k), F.lit(v))])
    steps = F.array(F.regexp_replace(lowered, r"(?U)[^\w\s]", " "))
    for suffix in V.LEGAL_SUFFIXES:
        steps = F.transform(steps, _without("(?iU)" + suffix))
    cleaned = F.transform(steps, lambda t: title_case(_spaced(t)))[0]
    return F.coalesce(F.try_element_at(acronyms, lowered), F.nullif(cleaned, F.lit("")), strip(name))


def canonical_attribute(attribute: Column) -> Column:
    """Lower case words; the first known synonym found replaces the whole name."""
    words = _spaced(F.regexp_replace(F.lower(attribute), r"(?U)[^\w\s]", " "))
    cleaned = F.coalesce(F.nullif(words, F.lit("")), strip(F.lower(attribute)))
    synonyms = [F.when(cleaned.rlike("(?U)" + pattern), F.lit(name)) for pattern, name in V.METRIC_SYNONYMS]
    return F.when(attribute != "", F.coalesce(*synonyms, cleaned))


def resolve_aliases(names: DataFrame, aliases: DataFrame, name: str = "cleaned", out: str = "canonical") -> DataFrame:
    """Stored canonical spelling of a cleaned name, else the cleaned name itself."""
    stored = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = names.join(stored, F.lower(name) == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_canonical", name)).drop("_alias", "_canonical")
