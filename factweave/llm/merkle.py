"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

Every row is a leaf: the digest of its fields. Per group, leaves in ascending order are folded by
FAN consecutive ones until one node is left, the group's subroot; the subroots, by group, are
folded to the root in the same way. Digests are lower-case hex text where they are hashed again.

A parent keeps a copy of its hash state before each child slot. Folding a replaced child
resumes the state of its slot, adds the replacement and the siblings to its right; what lies
to the left is never read again. Above a block, the states are resumed once from the left
siblings of the block's path and then serve all its leaves.

Leaves get their places from a range-partitioned, written table: places inside a partition plus
the sizes of the partitions before it. Blocks of FAN^BLOCK_LEVELS consecutive nodes are one
task's work, whatever the size of a group; a round leaves one node of each block. Then
the rounds go down again and hand each block the path from its top to the root. The
rounds grow with the logarithm of the rows to base FAN^BLOCK_LEVELS.

Defined results: nulls count as "-"; a null group comes first, a null order value comes first in
its group; rows of one order value are ordered by their leaves, and equal leaves are alike;
a group of one row has that leaf as its subroot; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.session import write_through

FAN = 2
BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(fields: list[Column]) -> Column:
    """SHA-256 of each field's UTF-8 byte count, a colon and its value, or of "-" where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


class Tree:
    """A fold of consecutive digests with a state kept before each child slot."""

    def __init__(self, digests: list[bytes], levels: int, fan: int = FAN):
        self.fan, self.nodes, self.states = fan, [digests], []
        for _ in range(levels):
            below, parents, states = self.nodes[-1], [], []
            for k in range(0, len(below), fan):
                state = hashlib.sha256()
                for child in below[k : k + fan]:
                    states.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.states.append(states)
            self.nodes.append(parents)

    def steps(self, i: int) -> list[tuple[bytes, bytes]]:
        """(left, right) siblings of node i and of its parents, level by level."""
        out = []
        for below in self.nodes[:-1]:
            first = i - i % self.fan
            out.append((b"".join(below[first:i]), b"".join(below[i + 1 : first + self.fan])))
            i //= self.fan
        return out

    def fold(self, i: int, replacement: bytes) -> bytes:
        """The top after node i is replaced."""
        for below, states in zip(self.nodes, self.states):
            state = states[i].copy()
            state.update(replacement)
            state.update(b"".join(below[i + 1 : i - i % self.fan + self.fan]))
            replacement = state.hexdigest().encode()
            i //= self.fan
        return replacement


def levels_of(n: int, most: int) -> int:
    """Levels that a block of a group of n nodes goes up in one round."""
    levels, size = 0, 1
    while size < n and levels < most:
        size *= FAN
        levels += 1
    return levels


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `place` (0, 1, 2 ... in each `key`) and `n`, the rows of the key."""
    by = ["key", *order]
    rows = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = write_through(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    sizes = rows.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("key", "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"), F.sum("size").over(Window.partitionBy("key")).alias("n"))
    return rows.join(shifts, ["key", "part"]).select(*nodes.columns, (F.col("at") - F.col("first") + F.col("shift")).alias("place"), "n")


def _in_blocks(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {FAN**most}"))


def _ordered(table: pa.Table, most: int) -> tuple[pa.Table, Tree]:
    table = table.sort_by("place")
    digests = [d.encode() for d in table.column("digest").to_pylist()]
    return table, Tree(digests, levels_of(table.column("n")[0].as_py(), most))


def _up(nodes: DataFrame, most: int) -> DataFrame:
    """One round: (key, digest, place, n) of the blocks' tops."""
    def top(table: pa.Table) -> pa.Table:
        _, tree = _ordered(table, most)
        first = table.slice(0, 1)
        n = first.column("n")[0].as_py()
        return pa.table({"key": first.column("key"), "digest": [tree.nodes[-1][0].decode()], "place": first.column("block"),
                         "n": pa.array([-(-n // FAN**most)], pa.int64())})

    return _in_blocks(nodes.select("key", "digest", "place", "n"), most).groupBy("key", "block").applyInArrow(top, "key string, digest string, place bigint, n bigint")


def rounds(nodes: DataFrame, name: str, most: int) -> list[DataFrame]:
    """The nodes of each round, from the given ones to one of each key; the last has `subroot` digests."""
    out = [nodes]
    while (out[-1].agg(F.max("n").alias("n")).first().n or 0) > 1:
        out.append(write_through(_up(out[-1], most), name))
    return out


def _down(nodes: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """(key, place, steps, subroot, root) of the nodes from those of their blocks' tops."""
    def extended(table: pa.Table, path: pa.Table) -> pa.Table:
        table, tree = _ordered(table, most)
        above, n = path.column("steps")[0].as_py(), table.num_rows
        steps = [[{"left": a.decode(), "right": b.decode()} for a, b in tree.steps(i)] + above for i in range(n)]
        same = lambda c: pa.array([path.column(c)[0].as_py()] * n, pa.string())
        return pa.table({"key": table.column("key"), "place": table.column("place"), "steps": pa.array(steps, _STEPS), "subroot": same("subroot"), "root": same("root")})

    left = _in_blocks(nodes.select("key", "digest", "place", "n"), most).groupBy("key", "block")
    right = paths.withColumnRenamed("place", "block").groupBy("key", "block")
    return left.cogroup(right).applyInArrow(extended, f"key string, place bigint, steps {STEPS}, subroot string, root string")


def _leaves(nodes: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """What `manifest` returns, of leaves (key, doc_id, digest, changed, place, n)."""
    def proved(table: pa.Table, path: pa.Table) -> pa.Table:
        table, tree = _ordered(table, most)
        above = [(s["left"].encode(), s["right"].encode()) for s in path.column("steps")[0].as_py()]
        resumed = [(hashlib.sha256(a), b) for a, b in above]
        tail = b"".join(a + b for a, b in above)
        changed, proofs, folded = table.column("changed").to_pylist(), [], []
        for i, leaf in enumerate(tree.nodes[0]):
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in tree.steps(i)) + tail).hexdigest())
            now = tree.fold(i, leaf if changed[i] is None else changed[i].encode())
            for state, right in resumed:
                state = state.copy()
                state.update(now)
                state.update(right)
                now = state.hexdigest().encode()
            folded.append(now.decode())
        same = lambda c: pa.array([path.column(c)[0].as_py()] * table.num_rows, pa.string())
        return pa.table({"doc_id": table.column("doc_id"), "leaf": table.column("digest"), "subroot": same("subroot"), "root": same("root"),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    right = paths.withColumnRenamed("place", "block").groupBy("key", "block")
    return _in_blocks(nodes, most).groupBy("key", "block").cogroup(right).applyInArrow(
        proved, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id",
             block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    proof_sha256 is the digest of all siblings on the way to the root. folded_root is the root
    as it would be with the digest `changed` in the leaf's place (null: the leaf itself).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    leaves = docs.select(
        key.alias("key"), F.col(order).alias("by"), F.col("doc_id").cast("bigint").alias("doc_id"),
        digest([F.col(f) for f in fields]).alias("digest"), (F.lit(None) if changed is None else changed).cast("string").alias("changed"))
    below = rounds(placed(leaves, ["by", "digest"], "leaves"), "tree-nodes", block_levels)
    # the subroots are the leaves of the tree above, all under one key
    tops = below[-1].select(F.lit("").alias("key"), F.col("key").alias("by"), "digest")
    above = rounds(placed(tops, ["by"], "subroots"), "tree-nodes", block_levels)
    root = above[-1].select("key", "place", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        root = write_through(_down(nodes, root, block_levels), "tree-paths")
    named = above[0].select("key", "place", F.col("by"), F.col("digest"))
    paths = named.join(root, ["key", "place"]).select(F.col("by").alias("key"), F.lit(0).cast("bigint").alias("place"), "steps", F.col("digest").alias("subroot"), "root")
    paths = write_through(paths, "tree-paths")
    for nodes in reversed(below[1:-1]):
        paths = write_through(_down(nodes, paths, block_levels), "tree-paths")
    return _leaves(below[0], paths, block_levels).withColumn("verified", F.col("folded_root") == F.col("root"))
