"""Mixing sources to target weights by Poisson replication.

The target repetition rate of a source is (its weight x the size of the mixture) / its size. A
document's count is the inverse of the Poisson distribution with that mean at a number in
[0, 1) that is hashed from seed and document, so it needs no state and is the same in every
run. Documents are repeated by their count and ordered by a hash of seed, document and copy.

Defined results: a null source is a source of its own; null and empty texts have size 0 and are
repeated like others of their source; a source of size 0 gets rate 0; repeated rows get equal
counts; a source without weight is left out; an empty table gives no rows. Extra columns are
carried; the two columns that are added take their names from parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave.session import write_through

SEED = 17
#: hex digits of a hash that make a number in [0, 1): 52 bits, exact in a double
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts (a null part counts as empty)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as a double can tell the next one from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def add(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("total"), F.array_append(acc["steps"], total).alias("steps"))

    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))
    filled = F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["steps"])
    return F.when(rate > 0, filled).otherwise(F.array(F.lit(1.0)))


def square_root_weights(sizes: DataFrame) -> DataFrame:
    """(source, weight): weights in proportion to the square root of a source's size."""
    total = sizes.agg(F.sum(F.sqrt("size"))).first()[0] or 1.0
    return sizes.select("source", (F.sqrt("size") / F.lit(total)).alias("weight"))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, size): code points of each source."""
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")
    return docs.groupBy("source").agg(F.sum(size).cast("double").alias("size"))


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """(source, rate) for a mixture of `scale` times the corpus. `weights`: (source, weight)."""
    sizes = write_through(source_sizes(docs), "source-sizes")
    weights = square_root_weights(sizes) if weights is None else weights
    total = sizes.agg(F.sum("size")).first()[0] or 0.0
    joined = sizes.join(weights.withColumnRenamed("source", "w_source"), F.col("source").eqNullSafe(F.col("w_source")))
    rate = F.when(F.col("size") > 0, F.col("weight") * F.lit(float(scale)) * F.lit(total) / F.col("size")).otherwise(0.0)
    return joined.select("source", rate.alias("rate"))


def mixed_records(docs: DataFrame, weights: DataFrame | None = None, scale: float = 1.0, seed: int = SEED) -> DataFrame:
    """(m_record, m_copy, m_key) of the mixture in shuffled order: a document as a struct of its
    columns, whatever their names, the number of the copy (from 0) and the key of the order."""
    rates = repetition_rates(docs, weights, scale)
    # written, so that Spark knows the size of this side before it picks the join
    steps = write_through(rates.select(F.col("source").alias("m_source"), poisson_steps(F.col("rate")).alias("m_steps")), "repetition-steps")
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("m_record"))
    joined = held.join(steps, F.col("m_record.source").eqNullSafe(F.col("m_source")))
    doc_id = F.col("m_record.doc_id")
    u = uniform(F.lit(seed), doc_id)
    count = F.size(F.filter("m_steps", lambda s: s <= u))
    repeated = joined.select("m_record", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))).alias("m_copy"))
    return repeated.select("m_record", "m_copy", uniform(F.lit(seed), doc_id, F.col("m_copy")).alias("m_key")).orderBy("m_key", doc_id, "m_copy")


def mix(docs: DataFrame, weights: DataFrame | None = None, scale: float = 1.0, seed: int = SEED,
        copy: str = "copy_no", order: str = "shuffle_key") -> DataFrame:
    """The mixture in shuffled order, with the number of the copy and the key of the order; a
    column of `docs` that has the name of one of these gives way to it."""
    kept = [F.col("m_record")[c].alias(c) for c in docs.columns if c.lower() not in (copy.lower(), order.lower())]
    return mixed_records(docs, weights, scale, seed).select(*kept, F.col("m_copy").alias(copy), F.col("m_key").alias(order))
