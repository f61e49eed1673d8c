"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave.session import remove_written, write_through


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands its least neighbour to the others (larger or smaller ones)."""
    if large:
        seen = edges.union(edges.select("v", "u"))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, where root is the least node it can reach.

    `edges` has columns u and v of one orderable type. Alternates large and small stars; each
    round is written to the shared folder, and the loop ends when a round changes nothing. A
    node of many edges is an aggregation key and one side of a join, never one task's list.
    """
    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = write_through(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, state = None, mark(now)
    while state != before and state[0]:
        earlier, now = now, write_through(_stars(_stars(now, large=True), large=False), "stars")
        remove_written(earlier)
        before, state = state, mark(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
