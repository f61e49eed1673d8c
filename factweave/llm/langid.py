"""Language identification by nearest centroids.

A text's letters (lower case, everything else one space) give counts of 1- to 3-grams of code
points, hashed to DIMENSIONS places, damped by log(1 + n), weighted by inverse document
frequency and scaled to length 1. Each language has several centroids from spherical k-means;
the language of the nearest centroid by cosine wins, and a text farther away than nearly all
the training texts of that language is rejected.

The classifier is fitted on a bounded sample: about SAMPLE_ROWS labelled rows in all, equally
many of each language, chosen by a hash of doc_id. Prediction looks at every whole text.

Defined results: `und` with score 0 for a null text, a text without a letter, or if there was
no labelled row to learn from; such texts are rejected (in the last case nothing else is); ties
go to the language that is first in alphabetical order; repeated rows get equal results; an
empty table gives no rows; other columns are carried or not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factweave.llm.common import STEP_CHARS, bound_batches, steps
from factweave.session import write_through

DIMENSIONS = 4096
SAMPLE_ROWS = 2400
#: languages that are learned; beyond, those of the most labelled rows
MAX_LANGUAGES = 400
CENTROIDS = 3
#: a text is rejected below this part of the cosine that 99 of 100 training texts reach
REJECT_PART = 0.5


@lru_cache
def _letters() -> np.ndarray:
    """For every code point its lower case if that is one letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for start, end in ((0, 0xD800), (0xE000, 0x34000)):
        for code in range(start, end):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
    return table


def features(text: str) -> np.ndarray | None:
    """Damped counts of hashed n-grams, or None for a text without a letter."""
    total = np.zeros(DIMENSIONS)
    found = False
    for k in range(0, len(text), STEP_CHARS):
        part = text[k : k + STEP_CHARS + 2]  # grams that start in this part
        codes = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not (codes != 32).any():
            continue
        found = True
        codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        mixed = codes * np.uint64(0x9E3779B97F4A7C15)
        two = (mixed[:-1] ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))
        three = (two[:-1] ^ (codes[2:] * np.uint64(0x165667B19E3779F9)))
        for grams in (mixed, two, three):
            places = ((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)
            total += np.bincount(places.astype(np.int64), minlength=DIMENSIONS)
    return np.log1p(total) if found else None


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # one centroid a row
    owner: np.ndarray  # index of the language of each
    least: np.ndarray  # for each language the cosine below which a text is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is accepted, for each text."""
        names, scores, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            counted = None if text is None else features(text)
            if counted is None:
                continue
            accepted[i] = not self.languages
            if self.languages:
                vector = counted * self.idf
                cosines = self.vectors @ (vector / np.linalg.norm(vector))
                best = int(self.owner[int(np.argmax(cosines))])
                names[i], scores[i] = self.languages[best], min(1.0, max(0.0, float(cosines.max())))
                accepted[i] = scores[i] >= self.least[best]
        return names, scores, accepted


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest text, then the farthest ones in turn."""
    mean = vectors.mean(axis=0)
    centres = [vectors[int(np.argmax(vectors @ mean))]]
    while len(centres) < min(k, len(vectors)):
        centres.append(vectors[int(np.argmin((vectors @ np.array(centres).T).max(axis=1)))])
    found = np.array(centres)
    for _ in range(rounds):
        nearest = np.argmax(vectors @ found.T, axis=1)
        sums = np.array([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else found[c] for c in range(len(found))])
        found = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return found


def fit(rows: DataFrame, text: Column, lang: Column, key: Column, sample_rows: int = SAMPLE_ROWS) -> Centroids:
    """Learns the centroids from rows whose lang is not null."""
    bound_batches(rows.sparkSession)
    labelled = rows.select(key.alias("key"), text.alias("text"), lang.alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return Centroids([], np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros(0))
    each = max(1, sample_rows // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64("key", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            made = [(lang, f) for lang, f in zip(batch.column(0).to_pylist(), map(features, texts)) if f is not None]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1].astype(np.float32).tobytes() for m in made], pa.binary())], names=["lang", "vector"])

    picked = labelled.filter(chance < F.try_element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(run, "lang string, vector binary")
    sampled = write_through(picked, "language-sample")  # about sample_rows vectors; they stay on the executors

    def dimensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of the texts have each dimension; dimension -1 counts the texts."""
        texts, found = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for vector in batch.column(0):
                found += np.frombuffer(vector.as_py(), np.float32) > 0
            texts += batch.num_rows
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMENSIONS), pa.int32()), pa.array([texts, *found.tolist()], pa.int64())], names=["place", "n"])

    counts = sampled.select("vector").mapInArrow(dimensions, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    if not counts:
        return Centroids([], np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros(0))
    by_place = {r["place"]: r["n"] for r in counts}
    idf = np.log((1 + by_place[-1]) / (1 + np.array([by_place[k] for k in range(DIMENSIONS)]))) + 1

    def learned(rows: pa.Table) -> pa.Table:
        """The centroids of one language and its least cosine."""
        own = np.array([np.frombuffer(v, np.float32) for v in sorted(rows["vector"].to_pylist())]).astype(float)
        own *= idf
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        found = _clusters(own, CENTROIDS)
        least = REJECT_PART * float(np.quantile((own @ found.T).max(axis=1), 0.01))
        return pa.table({"lang": [rows["lang"][0].as_py()], "centres": [found.tobytes()], "least": [least]})

    model = sorted(tuple(r) for r in sampled.groupBy("lang").applyInArrow(learned, "lang string, centres binary, least double").collect())
    centres = [np.frombuffer(bytes(c)).reshape(-1, DIMENSIONS) for _, c, _ in model]
    owner = np.repeat(np.arange(len(model)), [len(c) for c in centres])
    return Centroids([lang for lang, _, _ in model], idf, np.concatenate(centres), owner, np.array([least for _, _, least in model]))


def classify(docs: DataFrame, text: Column, carried: Column, model: Centroids) -> DataFrame:
    """(carried, lang_pred, score, accepted) for each row; `carried` may be a struct."""
    rows = docs.select(carried.alias("carried"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _ in steps(iter([batch]), 1):
                names, scores, accepted = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores), pa.array(accepted)],
                                                 names=["carried", "lang_pred", "score", "accepted"])

    schema = T.StructType([rows.schema["carried"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("accepted", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    model = fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"), sample_rows)
    record = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return classify(docs, F.col("text"), record, model).filter("accepted").select("carried.*")
