"""Counting fact pairs per relation without listing them.

Groups of up to SMALL_GROUP facts are counted as their pairs are made, in one join after one
exchange of the compared columns; nothing else of them reaches a disk. In larger groups pairs
are not made either:

Low confidence and different periods are settled by arithmetic on group sizes. What is left
meets within a period. There numbers are classed by all that decides a context (scope, currency,
unit, whether the value can be a fraction); pairs of classes, not of facts, show where the
context differs and by which factors values become comparable. How many values of two
comparable classes lie within the tolerance is counted on sorted values: each value asks for
the numbers of values up to the two ends of its interval, values and ends are sorted together,
and prefix sums answer them. The order is cut into ranges that are summed apart, so neither
a hot group nor a hot value is one task's work; the whole is n log n. Only claims in words are
compared in pairs, distinct text with distinct text.

The rules read a pair in the order of its fact ids; in large groups the order is one of classes. It matters
only where two currencies meet and a value is below SMALLEST_DENOMINATOR (the tolerance is
absolute there) or one of them is a percentage and the other a fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import relative_delta
from factweave.operators.ordered import large_groups
from factweave.operators.pairs import pair_across
from factweave.operators.reconcile import COMPARED, apply_rules, claims, clean, prepared, sides
from factweave.session import write_through

BY = ["entity_canon", "attribute_canon"]
#: facts of a group whose pairs are made and counted at once
SMALL_GROUP = 256
#: steps of the last binary place around an interval's computed end, in which the exact end lies
ULPS = range(-4, 5)
_FINITE = 1.7976931348623157e308


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def _name(*parts: Column) -> Column:
    """Sixteen bytes that stand for the parts, since names travel with every value; parts but the last are of fixed length."""
    return F.unhex(F.md5(F.concat(*[p.cast("binary") for p in parts])))


def _whole(n: Column) -> Column:
    return n.cast("decimal(19,0)")


def _nearest(end: Column, x: Column, largest: bool) -> Column:
    """The outermost double near the computed end that is still within the tolerance of x."""
    near = F.array(*[end * F.lit(1 + k * 2.0**-52) for k in ULPS])
    inside = F.filter(near, lambda e: relative_delta(e, x) <= V.TOLERANCE)
    return F.coalesce(F.array_max(inside) if largest else F.array_min(inside), x)


def tolerance_interval(x: Column) -> tuple[Column, Column]:
    """The least and greatest number whose relative delta to x is within the tolerance."""
    size, t, eps = F.abs(x), V.TOLERANCE, V.SMALLEST_DENOMINATOR
    outer = F.when(size <= eps * (1 - t), size + t * eps).otherwise(size / (1 - t))
    inner = size - F.lit(t) * F.greatest(size, F.lit(eps))
    low, high = F.when(x >= 0, inner).otherwise(-outer), F.when(x >= 0, outer).otherwise(-inner)
    return _nearest(low, x, False), _nearest(high, x, True)


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys up to and including the row's
    order values. Ranges of the order are summed apart and shifted by the sums before them."""
    by = [*keys, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    ranged = write_through(ranged, "ranges")
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")).select(
        *keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    return ranged.withColumn("_inside", F.sum(value).over(inner)).join(shifts, [*keys, "_part"]).withColumn(
        out, F.col("_inside") + F.col("_shift")).drop("_inside", "_shift", "_part")


def _period() -> Column:
    return F.concat(F.lit("="), F.col("period_key"))


def _meeting(rows: DataFrame, *places: Column) -> DataFrame:
    """Rows at each of the places (null: none) where they meet others."""
    return rows.withColumn("meet", F.explode(F.array_compact(F.array(*places)))).drop("period_key")


def _numeric(sure: DataFrame) -> DataFrame:
    """Counts over pairs of numbers with compatible periods: (*BY, relation, n_pairs)."""
    value = F.col("norm_value").cast("double")
    fraction = value.between(0.0, 1.0)
    named = _name(F.concat_ws("\x01", *BY, "period_key", F.lower(clean(F.col("scope"))), F.upper(clean(F.col("currency"))),
                              F.lower(clean(F.col("norm_unit"))), fraction.cast("string")))
    pair, line = _name(F.col("a_class"), F.col("b_class")), _name(F.col("a_class"), F.col("fa").cast("string"))
    numbers = sure.filter(F.col("norm_value").isNotNull()).withColumn("class", named)
    match_self = F.when(F.abs(value) <= _FINITE, F.col("members")).otherwise(0)
    shown = ["scope", "currency", "norm_unit", "norm_value"]
    classes = numbers.groupBy(*BY, "period_key", "class").agg(
        *[F.first(c).alias(c) for c in shown], F.sum("members").alias("n"), F.sum(match_self).alias("n_self"))
    classes = write_through(classes.withColumn("confidence", F.lit(1.0)), "number-classes")
    undated = F.col("period_key") == ""
    left, right = _meeting(classes, _period(), F.when(undated, "undated")), _meeting(classes, _period(), F.when(~undated, "undated"))
    p = sides(pair_across(left, right, [*BY, "meet"]).filter((F.col("meet") == "undated") | (F.col("a_class") <= F.col("b_class"))).drop("meet"))
    met = write_through(p.select(
        *BY, "a_class", "b_class", "_context", (F.col("a_class") == F.col("b_class")).alias("one"), "a_n", "b_n", "a_n_self",
        F.when(F.col("_af"), F.lit(100.0)).otherwise(F.lit(1.0)).alias("fa"),
        F.when(F.col("_bf"), F.lit(100.0)).otherwise(F.coalesce("_rate", F.lit(1.0))).alias("fb")), "class-pairs")
    every = F.when(F.col("one"), _choose2(_whole(F.col("a_n")))).otherwise(_whole(F.col("a_n")) * _whole(F.col("b_n"))).cast("decimal(38,0)")
    alone = met.select(*BY, "_context", pair.alias("pair"), "one", "a_n_self", every.alias("every"))

    values = numbers.select("class", value.alias("v"), "members").filter(F.abs("v") <= _FINITE)
    compared = met.filter(~F.col("_context")).select(
        "a_class", "b_class", "fa", "fb", pair.alias("pair"), line.alias("line"))
    points = values.withColumnRenamed("class", "a_class").join(compared.select("a_class", "fa", "line").distinct(), "a_class").select(
        "line", (F.col("v") * F.col("fa")).alias("at"), F.lit(1).alias("place"), F.lit("").cast("binary").alias("pair"), "members", F.lit(0).cast("long").alias("asks"))
    asking = values.withColumnRenamed("class", "b_class").join(compared, "b_class").withColumn("x", F.col("v") * F.col("fb"))
    low, high = tolerance_interval(F.col("x"))
    ends = F.explode(F.array(F.struct(low.alias("at"), F.lit(0).alias("place"), (-F.col("members")).alias("asks")),
                             F.struct(high.alias("at"), F.lit(2).alias("place"), F.col("members").alias("asks"))))
    asked = asking.select("line", "pair", ends.alias("e")).select("line", "e.at", "e.place", "pair", F.lit(0).cast("long").alias("members"), "e.asks")
    events = points.unionByName(asked).groupBy("line", "at", "place", "pair").agg(F.sum("members").alias("members"), F.sum("asks").alias("asks"))
    summed = prefix_sums(events, ["line"], ["at", "place"], "members", "below").filter("place <> 1")
    near = summed.groupBy("pair").agg(F.sum((_whole(F.col("below")) * _whole(F.col("asks"))).cast("decimal(38,0)")).alias("near"))

    counted = alone.join(near, "pair", "left").withColumn("near", F.coalesce("near", F.lit(0)))
    within = F.when(F.col("_context"), 0).when(F.col("one"), (F.col("near") - F.col("a_n_self")) / 2).otherwise(F.col("near")).cast("decimal(38,0)")
    beyond = F.when(~F.col("_context"), F.col("every") - within)
    rows = F.explode(F.array(
        F.struct(F.lit("contextual_variance").alias("relation"), F.when(F.col("_context"), F.col("every")).alias("n_pairs")),
        F.struct(F.lit("corroborates").alias("relation"), within.alias("n_pairs")),
        F.struct(F.lit("contradicts").alias("relation"), beyond.cast("decimal(38,0)").alias("n_pairs"))))
    return counted.select(*BY, rows.alias("r")).select(*BY, "r.*")


def _worded(sure: DataFrame) -> DataFrame:
    """Counts over pairs of which one side has no number: (*BY, relation, n_pairs)."""
    texts = sure.filter(F.col("norm_value").isNull())
    numbers = sure.filter(F.col("norm_value").isNotNull()).join(texts.select(*BY).distinct(), BY, "left_semi")
    undated, is_text = F.col("period_key") == "", F.col("norm_value").isNull()
    # a text meets all of its period; an undated text meets all dated rows, an undated number dated texts
    left = _meeting(texts, _period(), F.when(undated, "undated text")).unionByName(_meeting(numbers, F.when(undated, "undated number")))
    right = _meeting(texts.unionByName(numbers), _period(), F.when(~undated, "undated text"), F.when(~undated & is_text, "undated number"))
    once = ~F.col("meet").startswith("=") | F.col("b_norm_value").isNotNull() | (F.col("a_fact_id") <= F.col("b_fact_id"))
    met = pair_across(left, right, [*BY, "meet"]).filter(once).drop("meet")
    a, b = _whole(F.col("a_members")), _whole(F.col("b_members"))
    weight = F.when(F.col("a_fact_id") == F.col("b_fact_id"), _choose2(a)).otherwise(a * b).cast("decimal(38,0)")
    return apply_rules(met, explain=False).select(*BY, "relation", weight.alias("n_pairs"))


def _of_small_groups(known: DataFrame) -> DataFrame:
    """Counts over all pairs of groups that are small: (*BY, relation, n_pairs)."""
    compared = [c for c in known.columns if c in (*COMPARED, "quote") and c != "document_id"]
    told = prepared(known.select(*BY, *compared)).drop(*[c for c in compared if c != "fact_id"])
    told = told.repartition(*BY)  # one exchange for both sides
    side = lambda s: told.select(*BY, *[F.col(c).alias(f"{s}_{c}") for c in told.columns if c not in BY])
    met = side("a").hint("merge").join(side("b"), BY).filter(F.col("a_fact_id") < F.col("b_fact_id"))
    return apply_rules(met, explain=False).groupBy(*BY, "relation").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n_pairs"))


def relation_counts(facts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Number of fact pairs per relation, per `group` (of entity_canon, attribute_canon) if given."""
    known = facts.dropna(subset=BY)
    large = large_groups(known, BY, SMALL_GROUP)
    if large.isEmpty():  # facts are not shuffled for a path that none of them takes
        counts = _of_small_groups(known)
    else:
        counts = _of_small_groups(known.join(large, BY, "left_anti")).unionByName(_of_large_groups(known.join(large, BY, "left_semi")))
    return counts.groupBy(*(group or []), "relation").agg(F.sum("n_pairs").cast("long").alias("n_pairs"))


def _of_large_groups(known: DataFrame) -> DataFrame:
    """Counts over all pairs of groups of any size, by arithmetic and sorted values: (*BY, relation, n_pairs)."""
    c = write_through(claims(known), "claims")
    n = _whole(F.col("members"))
    per_period = c.groupBy(*BY, "period_key").agg(F.sum(n).alias("n"), F.sum(F.when(~F.col("low"), n).otherwise(0)).alias("ok"))
    dated = F.when(F.col("period_key") != "", F.col("ok")).otherwise(0).cast("decimal(19,0)")
    square = (dated * dated).cast("decimal(38,0)")
    sizes = per_period.groupBy(*BY).agg(F.sum("n").cast("decimal(19,0)").alias("n"), F.sum("ok").cast("decimal(19,0)").alias("ok"),
                                        F.sum(dated).cast("decimal(19,0)").alias("dated"), F.sum(square).alias("squares"))
    low = (_choose2(F.col("n")) - _choose2(F.col("ok"))).cast("decimal(38,0)")
    apart = ((F.col("dated") * F.col("dated") - F.col("squares")) / 2).cast("decimal(38,0)")
    arithmetic = sizes.select(*BY, F.explode(F.array(
        F.struct(F.lit("needs_review").alias("relation"), low.alias("n_pairs")),
        F.struct(F.lit("contextual_variance").alias("relation"), apart.alias("n_pairs")))).alias("r")).select(*BY, "r.*")
    sure = c.filter(~F.col("low")).withColumn("period", F.nullif("period_key", F.lit("")))
    return arithmetic.unionByName(_numeric(sure)).unionByName(_worded(sure)).filter(F.col("n_pairs") > 0)
