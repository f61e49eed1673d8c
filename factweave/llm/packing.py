"""Packing by cutting stock with column generation.

A document is its token ids and an end id. It is cut into full pieces of `size` ids, which are
sequences of their own, and one remainder. Remainders are cutting stock: their lengths, rounded
up to `unit` ids, give a histogram of at most size / unit classes. A linear program chooses how
often to use each pattern (a multiset of classes that fits a sequence); a knapsack dynamic
program prices new patterns until none improves. The solution is rounded down, what is left is
packed by first fit decreasing, and the documents of each class, ranked, take the places of the
patterns. Only the histogram (its size is fixed by `size` and `unit`) reaches the driver.

Ranks are counted in shards of a class and shifted by the sizes of the shards before, so that a
class that holds most rows is not sorted in one task.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as
they come; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.llm.common import bound_batches, steps
from factweave.llm.tokens import Encoder
from factweave.session import write_through

SIZE, UNIT, END_ID = 2048, 16, 1
#: the linear program is solved to this part of its optimum
GAP = 5e-4
#: rows that a shard of a class holds on average
SHARD_ROWS = 100_000
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


@lru_cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: (doc_id, start, length, doc_tokens, ids as little-endian uint32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch, texts in steps(batches, 1):
            keys, rows = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, encode(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(key, k, min(size, len(ids) - k), len(ids), ids[k : k + size].tobytes()) for k in range(0, len(ids), size)]
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def _best_pattern(prices: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total price (unbounded knapsack); classes are 1..len(prices) units."""
    usable = np.where(demand > 0, prices, -1.0)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(room, len(prices))
        gains = usable[:k] + value[room - k : room][::-1]  # class c leaves room - c
        c = int(np.argmax(gains))
        if gains[c] > value[room - 1]:
            value[room], choice[room] = gains[c], c + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(len(prices), np.int64), capacity
    while room:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def solve(demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, so that every piece has its place.

    demand[c - 1]: pieces of c units. Revised simplex on the covering program (one row a
    class), starting from one pattern per class.
    """
    classes = np.flatnonzero(demand > 0)
    if not len(classes):
        return []
    m = len(classes)
    basis = [np.where(classes == c, capacity // (c + 1), 0).astype(float) for c in classes]
    inverse = np.diag([1.0 / (capacity // (c + 1)) for c in classes])
    amounts = inverse @ demand[classes]
    for turn in range(50 * m):
        if turn % 100 == 99:
            inverse = np.linalg.inv(np.array(basis).T)
            amounts = inverse @ demand[classes]
        prices = np.zeros(len(demand))
        prices[classes] = inverse.sum(axis=0)
        worth, pattern = _best_pattern(prices, demand, capacity)
        if worth <= 1 + GAP:  # no plan needs fewer sequences than this one's number divided by `worth`
            break
        column = inverse @ pattern[classes]
        up = column > 1e-9
        ratios = np.where(up, np.maximum(amounts, 0) / np.where(up, column, 1), np.inf)
        out = int(np.argmin(ratios))
        amounts = amounts - ratios[out] * column
        amounts[out] = ratios[out]
        inverse[out] /= column[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(column[others], inverse[out])
        basis[out] = pattern[classes].astype(float)
    else:
        warnings.warn(f"packing plan not solved in {50 * m} turns: it may need up to {worth - 1:.2%} more sequences than the best", stacklevel=2)
    used, left = [], demand.astype(np.int64).copy()
    for amount, column in sorted(zip(amounts, basis), key=lambda x: -x[0]):
        pattern = np.zeros(len(demand), np.int64)
        pattern[classes] = np.rint(column).astype(np.int64)
        held = pattern > 0
        times = int(min(np.floor(amount + 1e-6), (left[held] // pattern[held]).min()))
        if times > 0:
            used.append((times, pattern))
            left -= times * pattern
    return used + _first_fit(left, capacity)


def _first_fit(left: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """What rounding leaves: at most a few pieces for each pattern of the basis."""
    rooms: list[int] = []
    patterns: list[np.ndarray] = []
    for c in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[c])):
            k = next((k for k, room in enumerate(rooms) if room > c), -1)
            if k < 0:
                rooms.append(capacity)
                patterns.append(np.zeros(len(left), np.int64))
            rooms[k] -= c + 1
            patterns[k][c] += 1
    return [(1, p) for p in patterns]


class Places:
    """Where the piece of rank r (from 0) in class c goes; bounded by the number of patterns."""

    def __init__(self, used: list[tuple[int, np.ndarray]], n_classes: int):
        self.starts: list[list[int]] = [[] for _ in range(n_classes)]
        self.each: list[list[int]] = [[] for _ in range(n_classes)]
        self.first: list[list[int]] = [[] for _ in range(n_classes)]
        filled, self.total = [0] * n_classes, 0
        for times, pattern in used:
            for c in np.flatnonzero(pattern):
                self.starts[c].append(filled[c])
                self.each[c].append(int(pattern[c]))
                self.first[c].append(self.total)
                filled[c] += times * int(pattern[c])
            self.total += times

    def sequences(self, classes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        found = np.empty(len(ranks), np.int64)
        for c in np.unique(classes):
            rows = np.flatnonzero(classes == c)
            starts, each, first = (np.array(x[c - 1], np.int64) for x in (self.starts, self.each, self.first))
            k = np.searchsorted(starts, ranks[rows], side="right") - 1
            found[rows] = first[k] + (ranks[rows] - starts[k]) // each[k]
        return found


def _ranked(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Adds `rank` from 0 within each class; rows have columns class and shard."""
    inside = Window.partitionBy("class", "shard").orderBy(*order)
    sizes = rows.groupBy("class", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("class", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(shifts, ["class", "shard"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift")


def assign(pieces: DataFrame, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, further columns). Pieces
    must read the same each time, as from a written table."""
    n_classes = -(-size // unit)
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    classed = pieces.select(*carried, F.when(F.col("length") < size, F.ceil(F.col("length") / unit)).otherwise(0).cast("int").alias("class"))
    histogram = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # n_classes + 1 rows at most
    demand = np.array([histogram.get(c, 0) for c in range(1, n_classes + 1)], np.int64)
    places = Places(solve(demand, n_classes), n_classes)
    shards = max(1, sum(histogram.values()) // SHARD_ROWS)
    order = [c for c in carried if c != "length"]
    sharded = classed.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int"))
    ranked = _ranked(sharded, order)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            classes, ranks = frame["class"].to_numpy(), frame["rank"].to_numpy()
            found = places.total + ranks  # a full piece is a sequence of its own
            held = classes > 0
            found[held] = places.sequences(classes[held], ranks[held])
            yield frame.drop(columns=["class", "shard", "rank"]).assign(sequence_id=found)

    kinds = dict(pieces.dtypes)
    placed = ranked.mapInPandas(place, ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", sequence_id bigint")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, unit: int = UNIT, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """All pieces with their ids and places. Places are found without the ids, which then meet
    them in one join; without `keep_ids` only their CRC-32 (ids_crc32) is kept."""
    found = token_pieces(docs, tokenizer, size, end_id).select(
        F.monotonically_increasing_id().alias("piece_no"), "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    pieces = write_through(found if keep_ids else found.drop("ids"), "pieces")
    placed = assign(pieces.drop("ids"), size, unit)
    if keep_ids:
        placed = placed.join(pieces.select("piece_no", "ids"), "piece_no")
    return placed.drop("piece_no")
