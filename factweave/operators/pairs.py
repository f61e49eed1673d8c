"""Candidate pairs of facts.

A pair table has the join keys once and every other column twice, as a_* and b_*, with
a's id smaller than b's. Hot groups are split: a group of n facts is cut into
ceil(n / block_rows) blocks and each pair of blocks becomes its own join key, so no task
ever holds more than two blocks of one group. The result is every pair, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factweave.session import remove_written, write_through

BLOCK_ROWS = 4096


def _side(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])


def _hot(facts: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Groups that are cut into blocks, as a written table that is cheap to look into."""
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
    return write_through(counts.select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")), "hot-groups")


def _with_cells(facts: DataFrame, hot: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Adds _block and one row per (_lo, _hi) block pair the fact takes part in."""
    blocked = facts.join(hot, keys, "left").withColumn(
        "_block",
        F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_column), F.col("_blocks")).cast("int")),
    )
    other = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    return (
        blocked.withColumn("_other", other)
        .withColumn("_lo", F.least("_block", "_other"))
        .withColumn("_hi", F.greatest("_block", "_other"))
        .drop("_blocks", "_other")
    )


def pair_up(
    facts: DataFrame,
    keys: list[str],
    condition: Callable[[], Column] | None = None,
    id_column: str = "fact_id",
    block_rows: int = BLOCK_ROWS,
    with_self: bool = False,
) -> DataFrame:
    """All pairs of rows with equal keys, each once; `condition` reads a_* and b_* columns."""
    usable = facts.dropna(subset=keys)
    hot = _hot(usable, keys, block_rows)
    if hot.isEmpty():  # nothing is cut: facts meet by their keys alone
        met = _side(usable, keys, "a").join(_side(usable, keys, "b"), keys)
        first, second = F.col(f"a_{id_column}"), F.col(f"b_{id_column}")
        pairs = met.filter(first <= second if with_self else first < second)
        return pairs if condition is None else pairs.filter(condition())
    cells = _with_cells(usable, hot, keys, id_column)
    join_keys = [*keys, "_lo", "_hi"]
    a, b = _side(cells, join_keys, "a"), _side(cells, join_keys, "b")
    ordered = F.col(f"a_{id_column}") < F.col(f"b_{id_column}")
    if with_self:
        # a row meets itself in its own block's diagonal cell only
        ordered = F.col(f"a_{id_column}") <= F.col(f"b_{id_column}")
    pairs = a.join(b, join_keys).filter(
        ordered & ((F.col("_lo") == F.col("_hi")) | (F.col("a__block") != F.col("b__block")))
    )
    if condition is not None:
        pairs = pairs.filter(condition())
    return pairs.drop("_lo", "_hi", "a__block", "b__block")


def pair_across(left: DataFrame, right: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every left row with every right row of the same keys; both sides of a hot group are cut into blocks."""
    left, right = left.dropna(subset=keys), right.dropna(subset=keys)
    hot_left, hot_right = _hot(left, keys, block_rows), _hot(right, keys, block_rows)
    if hot_left.isEmpty() and hot_right.isEmpty():  # nothing is cut: rows meet by their keys alone
        return _side(left, keys, "a").join(_side(right, keys, "b"), keys)
    cut_left, cut_right = hot_left.withColumnRenamed("_blocks", "_nl"), hot_right.withColumnRenamed("_blocks", "_nr")

    def cells(df: DataFrame, own: str, own_cell: str, other: str, other_cell: str) -> DataFrame:
        row = F.xxhash64(*[F.col(c) for c in df.columns])
        sized = df.join(cut_left, keys, "left").join(cut_right, keys, "left")
        return (
            sized.withColumn(own_cell, F.when(F.col(own).isNull(), 0).otherwise(F.pmod(row, F.col(own)).cast("int")))
            .withColumn(other_cell, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("_nl", "_nr")
        )

    join_keys = [*keys, "_i", "_j"]
    a = _side(cells(left, "_nl", "_i", "_nr", "_j"), join_keys, "a")
    b = _side(cells(right, "_nr", "_j", "_nl", "_i"), join_keys, "b")
    return a.join(b, join_keys).drop("_i", "_j")


def pair_key(a: str, b: str) -> list[Column]:
    """The order-free identity of a pair."""
    return [F.least(a, b).alias("first_id"), F.greatest(a, b).alias("second_id")]


def without_known(pairs: DataFrame, relations: DataFrame, a: str = "a_fact_id", b: str = "b_fact_id") -> DataFrame:
    """Pairs that no stored relation connects yet, in either direction."""
    known = relations.select(*pair_key("fact_a", "fact_b"))
    return pairs.join(
        known,
        (F.least(a, b) == F.col("first_id")) & (F.greatest(a, b) == F.col("second_id")),
        "left_anti",
    )


def exact_candidates(
    facts: DataFrame,
    relations: DataFrame | None = None,
    document_id: str | None = None,
    cross_document_only: bool = False,
    block_rows: int = BLOCK_ROWS,
    prepare: Callable[[DataFrame], DataFrame] = lambda facts: facts,
) -> DataFrame:
    """Pairs on the same entity and attribute, minus known pairs.

    With `document_id` one side must be that document; only facts of its groups are paired. Only
    pairs of two facts that relations name are looked up among the known ones; the others can't
    be known and are not shuffled. `prepare` adds columns to facts right before they meet.
    """
    keys = ["entity_canon", "attribute_canon"]
    if document_id is not None:
        # a group of the document is told to have a fact without a number, so that pairs in words need only such groups
        worded = F.col("norm_value").isNull() if "norm_value" in facts.columns else F.lit(True)
        groups = facts.groupBy(*keys).agg(F.max(F.col("document_id").eqNullSafe(document_id)).alias("_wanted"), F.max(worded).alias("_worded"))
        facts = write_through(facts.join(groups.filter("_wanted").drop("_wanted"), keys), "document-groups")

    def condition() -> Column:
        test = F.lit(True)
        if cross_document_only:
            test = test & (F.col("a_document_id") != F.col("b_document_id"))
        if document_id is not None:
            test = test & ((F.col("a_document_id") == document_id) | (F.col("b_document_id") == document_id))
        return test

    if relations is None:
        return pair_up(prepare(facts), keys, condition, block_rows=block_rows)
    named = relations.select(F.explode(F.array("fact_a", "fact_b")).alias("fact_id")).distinct().withColumn("_named", F.lit(True))
    told = write_through(facts.join(named, "fact_id", "left").withColumn("_named", F.col("_named").isNotNull()), "named-facts")
    if document_id is not None:
        remove_written(facts)
    both = F.col("a__named") & F.col("b__named")
    fresh = pair_up(prepare(told), keys, lambda: condition() & ~both, block_rows=block_rows).drop("a__named", "b__named")
    asked = pair_up(prepare(told.filter("_named").drop("_named")), keys, condition, block_rows=block_rows)
    return fresh.unionByName(without_known(asked, relations))


def directed(relations: DataFrame) -> DataFrame:
    """Each relation twice, once from either end, so that "touches this fact" is an equi join."""
    ends = F.explode(
        F.array(
            F.struct(F.col("fact_a").alias("fact_id"), F.col("fact_b").alias("counterpart_id")),
            F.struct(F.col("fact_b").alias("fact_id"), F.col("fact_a").alias("counterpart_id")),
        )
    )
    others = [c for c in relations.columns if c not in ("fact_a", "fact_b")]
    return relations.select(*others, ends.alias("_end")).select("_end.*", *others)
