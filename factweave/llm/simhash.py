"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits hold two blocks of 23 bits and 18 free ones. The codewords of the
perfect binary Golay code (length 23, every word within 3 bits of exactly one codeword) are
the anchors of a block; a pair of them is an anchor of the fingerprint. Its home is the pair
of nearest codewords. If two fingerprints differ in at most t bits, the home of one is, in each
block, within 3 bits plus that block's share of t of the other. So every fingerprint is
replicated to all anchors within covering radius plus threshold (the excess over 3 in both
blocks together is at most t: about 61 anchors for t = 2 out of 2^24), and homes meet replicas
by equality of the anchor. No pair is missed; equal fingerprints are merged before.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle; repeated rows share
a fingerprint; the id of a component is its smallest doc_id (null only if all ids in it are
null); an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from factweave.llm.common import bound_batches, numbered, steps
from factweave.llm.graph import roots
from factweave.session import write_through

# fixed values: the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the Golay code, its length and radius
GENERATOR, LENGTH, RADIUS = 0xAE3, 23, 3
MASK = (1 << LENGTH) - 1
BIT_BLOCK = 1 << 15


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The majority bits of the XXH64 values of all shingles of `width` words, as unsigned int."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(first), BIT_BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[k : k + BIT_BLOCK], last[k : k + BIT_BLOCK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, fp) per row; fp holds the 64 bits as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            found = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    bound_batches(rows.sparkSession)
    return rows.select(key.cast("bigint").alias("key"), text.alias("text")).mapInArrow(run, "key bigint, fp bigint")


@lru_cache
def _codewords_near(excess: int) -> list[list[np.ndarray]]:
    """near[s][e]: what to xor to a word of syndrome s to reach the codewords at RADIUS + e bits
    (for e = 0: at RADIUS or nearer, exactly one)."""
    rest = []
    for i in range(LENGTH):
        value = 1 << i
        for shift in range(i, 10, -1):
            if value >> shift & 1:
                value ^= GENERATOR << (shift - 11)
        rest.append(value)
    near: list[list[list[int]]] = [[[] for _ in range(excess + 1)] for _ in range(1 << 11)]
    for weight in range(RADIUS + excess + 1):
        for bits in combinations(range(LENGTH), weight):
            syndrome = pattern = 0
            for b in bits:
                syndrome ^= rest[b]
                pattern |= 1 << b
            near[syndrome][max(0, weight - RADIUS)].append(pattern)
    return [[np.array(p, np.int64) for p in by] for by in near]


@lru_cache
def _syndromes() -> np.ndarray:
    """The remainder of each byte at each of three places, for a look-up by bytes."""
    table = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            value = byte << (8 * place)
            for shift in range(LENGTH, 10, -1):
                if value >> shift & 1:
                    value ^= GENERATOR << (shift - 11)
            table[place, byte] = value
    return table


def syndrome(words: np.ndarray) -> np.ndarray:
    table = _syndromes()
    return table[0][words & 255] ^ table[1][words >> 8 & 255] ^ table[2][words >> 16 & 255]


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp & MASK, fp >> LENGTH & MASK


def home_anchor(fp: np.ndarray) -> np.ndarray:
    """The pair of nearest codewords."""
    nearest = np.array([by[0][0] for by in _codewords_near(0)], np.int64)
    a, b = _blocks(fp)
    return (a ^ nearest[syndrome(a)]) << LENGTH | (b ^ nearest[syndrome(b)])


def covering_anchors(fp: np.ndarray, threshold: int) -> list[np.ndarray]:
    """For each fingerprint all anchors within covering radius plus threshold."""
    near, (a, b) = _codewords_near(threshold), _blocks(fp)
    found = []
    for x, y, s, t in zip(a.tolist(), b.tolist(), syndrome(a).tolist(), syndrome(b).tolist()):
        second = [near[t][e] ^ y for e in range(threshold + 1)]
        parts = []
        for e in range(threshold + 1):
            reach = np.concatenate(second[: threshold + 1 - e])
            parts.append((((near[s][e] ^ x) << LENGTH)[:, None] | reach[None, :]).ravel())
        found.append(np.concatenate(parts))
    return found


def near_pairs(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints in column fp that differ in at most `threshold` bits."""
    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"anchor": home_anchor(frame["fp"].to_numpy()), "u": frame["fp"]})

    def replicas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 5000):
                fp = frame["fp"].to_numpy()[k : k + 5000]
                anchors = covering_anchors(fp, threshold)
                yield pd.DataFrame({"anchor": np.concatenate(anchors), "v": np.repeat(fp, [len(x) for x in anchors])})

    left = fps.select("fp").mapInPandas(homes, "anchor bigint, u bigint")
    right = fps.select("fp").mapInPandas(replicas, "anchor bigint, v bigint")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    return left.hint("merge").join(right, "anchor").filter((F.col("u") < F.col("v")) & close).select("u", "v")


def components(keyed: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, component_id) for a table of (key, fp): the smallest key that is reachable."""
    nodes = write_through(keyed.groupBy("fp").agg(F.min("key").alias("low")), "fingerprints")
    links = roots(near_pairs(nodes, threshold))
    rooted = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicate_groups(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document."""
    keyed = write_through(fingerprints(docs, F.col("doc_id"), F.col("text")), "simhash")
    grouped = write_through(components(keyed, threshold), "simhash-components")
    return keyed.join(grouped, "fp", "left").select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One document of each component with all its columns: the smallest doc_id (null ids last)."""
    rows = numbered(docs, "near-rows")
    ids = rows.select("row_no", F.col("record.doc_id").alias("doc_id"))
    keyed = write_through(fingerprints(rows, F.col("row_no"), F.col("record.text")), "simhash")
    grouped = components(keyed, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    best = keyed.join(ids.withColumnRenamed("row_no", "key"), "key").groupBy("fp").agg(first.alias("best"))
    kept = best.join(grouped, "fp").groupBy("component_id").agg(F.min("best").alias("best")).select(F.col("best.key").alias("row_no"))
    return rows.join(kept, "row_no", "left_semi").select("record.*")
