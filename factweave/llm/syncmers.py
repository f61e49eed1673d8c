"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the least hash among its s-mers is the first or the
last one. That depends on the k-mer alone, so equal passages have equal anchors wherever they
stand. A fingerprint holds every anchor whose hash is below one FRACTION-th of all hashes, so it
grows with the text, and the SKETCH least ones at any rate; each has the position of its first
occurrence, and they stand in text order. Likeness compares two fingerprints up to the hash
below which both are complete: of the anchors of both together, the shared ones that keep their
order in both texts are counted, and the share of the texts that this estimates (Dice) is
returned: 1 for equal texts, 0 for nothing in common. `passages` gives the stretches that two
texts share, from runs of shared anchors at one distance of their positions.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, like 1 to
another empty one and 0 to any other; a text shorter than k is one anchor; equal texts have
equal fingerprints; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factweave.llm.common import STEP_CHARS, bound_batches

K, S, SKETCH, FRACTION = 16, 6, 64, 32
#: hex digits of an anchor's hash and of its position in a fingerprint
HASH_DIGITS, PLACE_DIGITS = 10, 8
ENTRY = HASH_DIGITS + PLACE_DIGITS
#: hashes below this are in every fingerprint
ALWAYS = 16**HASH_DIGITS // FRACTION
BUCKET_ROWS, MAX_BUCKETS = 1000, 4096
LOWEST = -(2**63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all closed syncmers of a text."""
    if len(text) < K:
        whole = [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))] if text else []
        return np.zeros(len(whole), np.int64), np.array(whole, np.uint64)
    places, hashes = [], []
    for at in range(0, len(text) - K + 1, STEP_CHARS):
        part = text[at : at + STEP_CHARS + K - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        short = np.zeros(len(codes) - S + 1, np.uint64)
        for j in range(S):
            short = short * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(short)]
        short = _mixed(short)
        two = np.minimum(short[:-1], short[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        width = K - S + 1  # 11 s-mers in a k-mer
        n = len(short) - width + 1
        least = np.minimum(eight[:n], eight[width - 8 : width - 8 + n])
        chosen = np.flatnonzero((least == short[:n]) | (least == short[width - 1 :]))
        middle, last = short[chosen + (K - S) // 2], short[chosen + K - S]
        places.append(at + chosen)
        hashes.append(_mixed((short[chosen] * np.uint64(0xC2B2AE3D27D4EB4F) + middle) * np.uint64(0x165667B19E3779F9) + last))
    return np.concatenate(places), np.concatenate(hashes)


def fingerprint(text: str) -> str:
    """The kept anchors as hex digits, ordered by their place in the text."""
    places, hashes = anchors(text)
    hashes >>= np.uint64(64 - 4 * HASH_DIGITS)
    if len(hashes) > 40 * SKETCH:  # only the least ones matter; keep enough for repeats
        bound = max(int(np.partition(hashes, 20 * SKETCH)[20 * SKETCH]), ALWAYS)
        near = hashes <= bound
        if len(np.unique(hashes[near])) >= SKETCH:
            places, hashes = places[near], hashes[near]
    distinct, first = np.unique(hashes, return_index=True)
    n = max(SKETCH, int(np.searchsorted(distinct, ALWAYS)))
    rows = sorted(zip(places[first[:n]].tolist(), distinct[:n].tolist()))
    return "".join(f"{h:0{HASH_DIGITS}x}{p % 16**PLACE_DIGITS:0{PLACE_DIGITS}x}" for p, h in rows)


def _entries(print_: str) -> list[str]:
    """The hashes of a fingerprint in text order."""
    return [print_[i : i + HASH_DIGITS] for i in range(0, len(print_), ENTRY)]


def _known_up_to(entries: list[str]) -> str:
    """The greatest hash up to which a fingerprint holds all anchors of its text."""
    if len(entries) < SKETCH:
        return "f" * HASH_DIGITS
    return max(max(entries), f"{ALWAYS - 1:0{HASH_DIGITS}x}")


def likeness(a: str, b: str) -> float:
    """Share of the texts in common, 0 to 1, estimated from two fingerprints."""
    if a == b:
        return 1.0
    first, second = _entries(a), _entries(b)
    if not first or not second:
        return 0.0
    limit = min(_known_up_to(first), _known_up_to(second))
    first, second = ([h for h in own if h <= limit] for own in (first, second))
    rank = {h: i for i, h in enumerate(second)}
    shared = [rank[h] for h in first if h in rank]
    chain: list[int] = []  # longest run of shared anchors in the order of both texts
    for i in shared:
        k = bisect_left(chain, i)
        chain[k : k + 1] = [i]
    share = len(chain) / (len(first) + len(second) - len(shared))
    return 2 * share / (1 + share)


def passages(a: str, b: str, least: int = 3) -> list[tuple[int, int, int]]:
    """(start in the first text, start in the second, length) of shared stretches: `least` or more
    anchors that follow each other in both fingerprints at one distance of their positions."""
    first, second = ([(p[i : i + HASH_DIGITS], int(p[i + HASH_DIGITS : i + ENTRY], 16)) for i in range(0, len(p), ENTRY)] for p in (a, b))
    rank = {h: i for i, (h, _) in enumerate(second)}
    found, run = [], []  # run: (place in first, place in second, rank in second)
    for h, place in [*first, (None, 0)]:
        k = rank.get(h)
        here = None if k is None else (place, second[k][1], k)
        if run and here and here[2] == run[-1][2] + 1 and here[0] - here[1] == run[-1][0] - run[-1][1]:
            run.append(here)
            continue
        if len(run) >= least:
            found.append((run[0][0], run[0][1], run[-1][0] - run[0][0] + K))
        run = [here] if here else []
    return found


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ahead, doc_id, text), sorted for a stream in which each document is followed
    by the next one in descending doc_id (null last); the last is followed by the first.

    Ids are cut into buckets at quantiles. The first document of a bucket is also given to the
    bucket before it (`ahead`), so each text is shuffled once and no order is kept in one task.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("key"))
    n = ids.count()
    buckets = min(MAX_BUCKETS, n // BUCKET_ROWS + 1)
    cuts: list[int] = []
    if buckets > 1:
        quantiles = ids.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")).first()["q"]
        cuts = sorted(set(quantiles))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda c: c < F.col("key"))) if cuts else F.lit(0)
    heads = sorted((r["bucket"], r["head"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("head")).collect())  # MAX_BUCKETS rows at most
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("ahead"), "doc_id", "text")
    before = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    other = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("key")]
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("ahead"))
    also = F.struct(other.cast("int").alias("bucket"), F.lit(True).alias("ahead"))
    dealt = rows.select(F.explode(F.when(F.col("key").isin(list(before)), F.array(own, also)).otherwise(F.array(own))).alias("to"), "key", "doc_id", "text")
    flat = dealt.select("to.bucket", "to.ahead", "key", "doc_id", "text").repartition("bucket")
    return flat.sortWithinPartitions("bucket", "ahead", F.desc("key"), "text").select("bucket", "ahead", "doc_id", "text")


REPORT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its last half replaced by the
    start of the next document), and its likeness to the edited text and to the next document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, ahead, doc_id, text, fingerprint)
        for batch in batches:
            rows = []
            for bucket, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == bucket and held[1]:
                    continue  # further rows of the id ahead
                now = (bucket, ahead, doc_id, text, fingerprint(text))
                if held and held[0] == bucket:
                    rows.append(report(held, now))
                held = now
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    def report(own, following) -> dict:
        _, _, doc_id, text, print_ = own
        half = len(text) // 2
        edited = text[: len(text) - half] + following[3][:half]
        edited_print = fingerprint(edited)
        return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": print_, "edited_fingerprint": edited_print, "near_edited": likeness(print_, edited_print),
                "near_next": likeness(print_, following[4])}

    bound_batches(docs.sparkSession)
    return _with_next(docs.select("doc_id", "text")).mapInArrow(run, REPORT)


SCHEMA = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in REPORT.split(", ")])
