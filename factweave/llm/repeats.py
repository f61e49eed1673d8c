"""Repeated passages by recompression.

Rounds name runs of equal symbols and pairs of adjacent symbols, starting from words. A symbol's
coin (a bit of a hash of its name) makes it a left or a right one, and each left-right pair is
merged; so what a symbol becomes depends on itself and its neighbours alone, and equal word
sequences get equal symbols inside. Names are 64-bit hashes of what they name, which makes them
global without a dictionary. Each symbol knows its support: the words that settle it. A window
of `width` words is represented by a symbol of the highest round whose support lies inside it,
named by the words of the support; wherever the same words stand, they are represented by the
same symbol at the same place.

1. Every document's representatives are counted globally. Only windows whose representative
   occurs in two documents can be repeats.
2. Those windows are compared as (symbol, hash of their words), 128 bits, and each learns the
   smallest doc_id in which it starts.
3. The words covered by repeated windows are removed.

In each round of exchange the rows of one step inside a task (some hundred documents) are
combined before: a window that also starts in a smaller document of the step is settled there,
so a passage that a third of all documents share sends one row a step, not one a document.

Defined results: a null or empty text has no words; texts shorter than a window are kept; rows
with equal doc_id don't remove each other's words; a null doc_id counts as larger than all; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from factweave.llm.common import bound_batches, steps

WIDTH = 13
#: pairs are merged in each round; runs are named before the rounds in RUN_ROUNDS
ROUNDS, RUN_ROUNDS = 3, (0,)
LAST = 2**63 - 1
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a * C1 + C3) * C2 + b)


def word_hashes(words: list[list[bytes]]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for own in words for w in own), np.uint64, sum(map(len, words)))


class Level:
    """Symbols of one round: names, supports [first, last) and documents, in text order."""

    def __init__(self, name, first, last, doc):
        self.name, self.first, self.last, self.doc = name, first, last, doc

    def _neighbours(self, starts, ends):
        """first of the symbol before, last of the symbol after; beyond a document's end: outside."""
        before = np.concatenate(([-1], self.first[:-1]))
        after = np.concatenate((self.last[1:], [LAST]))
        new = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))
        end = np.concatenate((new[1:], [True]))
        return np.where(new, starts[self.doc] - 1, before), np.where(end, ends[self.doc] + 1, after)

    def runs(self, starts, ends) -> Level:
        if not len(self.name):
            return self
        new = np.concatenate(([True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])))
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(new)))
        before, after = self._neighbours(starts, ends)
        name = np.where(length > 1, _join(self.name[at], length.astype(np.uint64)), self.name[at])
        return Level(name, before[at], after[at + length - 1], self.doc[at])

    def pairs(self, turn: int, starts, ends) -> Level:
        if not len(self.name):
            return self
        left = (_mix(self.name + np.uint64(turn * 0x632BE5AB % 2**32)) >> np.uint64(40) & np.uint64(1)) == 0
        opens = np.concatenate((left[:-1] & ~left[1:] & (self.doc[:-1] == self.doc[1:]), [False]))
        closes = np.concatenate(([False], opens[:-1]))
        at = np.flatnonzero(~closes)
        merged, following = opens[at], np.minimum(at + 1, len(left) - 1)
        before, after = self._neighbours(starts, ends)
        name = np.where(merged, _join(self.name[at], self.name[following]), self.name[at])
        first = np.where(merged | left[at], self.first[at], before[at])
        last = np.where(merged, self.last[following], np.where(left[at], after[at], self.last[at]))
        return Level(name, first, last, self.doc[at])


def representatives(hashes: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, symbol) of each window; documents' words lie one after another."""
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes))
    level = Level(hashes, place, place + 1, doc)
    levels = [level]
    for turn in range(ROUNDS):
        if turn in RUN_ROUNDS:
            level = level.runs(starts, ends)
        level = level.pairs(turn, starts, ends)
        levels.append(level)
    window = np.flatnonzero(place + width <= ends[doc]) if len(hashes) else place
    first, last = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
    open_ = np.arange(len(window))
    for level in levels[::-1]:
        begin = window[open_]
        below = np.cumsum(np.bincount(np.clip(level.first + 1, 0, len(hashes)), minlength=len(hashes) + 1))
        k = below[begin]  # the first symbol whose support starts in the window
        inside = k < len(level.name)
        k = np.minimum(k, len(level.name) - 1)
        inside &= level.last[k] <= begin + width
        rank = _mix(level.name ^ C3)
        chosen, best = k, rank[k]
        for further in (1, 2, 3):  # of up to four symbols inside, the one of the least hash
            j = np.minimum(k + further, len(level.name) - 1)
            better = inside & (level.last[j] <= begin + width) & (rank[j] < best)
            chosen, best = np.where(better, j, chosen), np.where(better, rank[j], best)
        settled = open_[inside]
        first[settled], last[settled] = level.first[chosen[inside]], level.last[chosen[inside]]
        open_ = open_[~inside]
        if not len(open_):
            break
    return doc[window], window - starts[doc[window]], Spans(hashes).named(first, last)


class Spans:
    """Names of word ranges, equal for equal words: differences of a running sum, scaled back."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(hashes + C2) * _powers(C1, n), dtype=np.uint64)))
        self.back = _powers(np.uint64(pow(int(C1), -1, 2**64)), n + 1)

    def named(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mix((self.sums[last] - self.sums[first]) * self.back[first] + last.astype(np.uint64) - first.astype(np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers) if n else powers


def _parsed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some texts, one after another, and the number of words of each."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    return word_hashes(words), np.fromiter(map(len, words), np.int64, len(words))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted columns begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def shared_symbols(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, symbols): for each document id the representatives that other documents have too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            keys = batch.column(0).to_numpy()
            doc, _, symbol = representatives(*_parsed(texts), width)
            key = keys[doc]
            order = np.lexsort((key, symbol))
            key, symbol = key[order], symbol[order]
            once = _firsts(symbol, key)
            key, symbol = key[once], symbol[once]
            head = _firsts(symbol)
            shared = np.repeat(np.diff(np.append(np.flatnonzero(head), len(head))) > 1, np.diff(np.append(np.flatnonzero(head), len(head))))
            apart = _join(symbol, key.astype(np.uint64)).view(np.int64)  # settled rows are spread by themselves
            symbol = symbol.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(head, symbol, apart)), pa.array(symbol, mask=head), pa.array(key), pa.array(shared)],
                names=["meet", "symbol", "key", "shared"])

    counted = docs.select("key", "text").mapInArrow(run, "meet bigint, symbol bigint, key bigint, shared boolean")
    met = F.expr("count(1) over (partition by meet)")
    found = counted.withColumn("n", met).filter("shared or n > 1")
    return found.groupBy("key").agg(F.collect_list(F.coalesce("symbol", "meet")).alias("symbols"))


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, removed): for the texts of a key, by their hash, the first words of the windows that
    also start in a row with a smaller key. `docs` has key, content (the hash) and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 2):
            keys, contents = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hashes, counts = _parsed(texts)
            doc, place, symbol = representatives(hashes, counts, width)
            lists = batch.column(3)
            owner = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
            known = _join(lists.flatten().to_numpy().view(np.uint64), owner.astype(np.uint64))
            open_ = np.isin(_join(symbol, doc.astype(np.uint64)), known)
            doc, place, symbol = doc[open_], place[open_], symbol[open_]
            begin = place + (np.cumsum(counts) - counts)[doc]
            words = Spans(hashes).named(begin, begin + width)
            order = np.lexsort((place, doc, keys[doc], words, symbol))
            doc, place, symbol, words = doc[order], place[order], symbol[order], words[order]
            key = keys[doc]
            group = np.cumsum(_firsts(symbol, words)) - 1
            least = key[_firsts(symbol, words)][group] if len(key) else key
            later = key > least
            # one row for each stretch of windows with one symbol that only other steps can settle
            asked = np.flatnonzero(~later)
            asked = asked[np.lexsort((place[asked], doc[asked], symbol[asked]))]
            rows = np.flatnonzero(_firsts(symbol[asked], doc[asked], place[asked] - np.arange(len(asked))))
            # one row for each document with what is settled here
            done = np.flatnonzero(later)
            done = done[np.argsort(doc[done], kind="stable")]
            done_at = np.flatnonzero(_firsts(doc[done]))
            owner = np.concatenate((doc[asked[rows]], doc[done[done_at]]))
            apart = _join(keys[doc[done[done_at]]].astype(np.uint64), contents[doc[done[done_at]]].astype(np.uint64))
            asks = np.append(rows, np.full(len(done_at) + 1, len(asked))).astype(np.int32)
            settled = np.concatenate((np.zeros(len(rows), np.int64), np.append(done_at, len(done)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((symbol[asked[rows]], apart)).view(np.int64)), pa.array(keys[owner]), pa.array(contents[owner]),
                 pa.array(np.concatenate((place[asked[rows]], np.full(len(done_at), -1))).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(asks), pa.array(words[asked].view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(settled), pa.array(place[done].astype(np.int32)))],
                names=["symbol", "key", "content", "start", "words", "places"])

    candidates = docs.join(shared_symbols(docs, width), "key").select("key", "content", "text", "symbols").mapInArrow(
        run, "symbol bigint, key bigint, content int, start int, words array<bigint>, places array<int>")
    # dealt by symbol, a row may carry all its windows; they are laid out where they meet
    settled = F.col("start") < 0
    one = F.transform("words", lambda w, i: F.struct(w.alias("words"), F.array(F.col("start") + i).alias("places")))
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("words"), F.col("places").alias("places")))
    windows = candidates.repartition("symbol").select("symbol", "key", "content", settled.alias("settled"), F.explode(F.when(settled, whole).otherwise(one)).alias("w"))
    least = F.expr("min(key) over (partition by symbol, words)")
    found = windows.select("symbol", "w.words", "key", "content", "settled", "w.places").withColumn("least", least).filter("settled or key > least")
    each = found.groupBy("key", "content").agg(F.flatten(F.collect_list("places")).alias("places"))
    return each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("content", "places"))).alias("removed"))


def covered(n: int, places: list[int] | None, width: int = WIDTH) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    edges = np.zeros(n + 1, np.int64)
    if places is not None and len(places):
        at = np.unique(np.asarray(places, np.int64))
        edges[at] += 1
        np.subtract.at(edges, at + width, 1)
    return np.cumsum(edges)[:n] > 0


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text less its repeated words.

    Texts are shuffled once: both joins by key read the same exchange.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            rows = []
            for text, places in zip(texts, batch.column(2)):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = covered(len(words), places.values.to_numpy() if places.is_valid else None, width)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                rows.append((len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
            n, removed, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["key", "n_words", "n_removed", "kept_text"])

    bound_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.hash(text).alias("content"), text.alias("text"))
    joined = keyed.join(repeated_windows(keyed, width), "key", "left").select("key", "text", F.try_element_at("removed", F.col("content")).alias("places"))
    kept = joined.mapInArrow(run, "key bigint, n_words bigint, n_removed bigint, kept_text string")
    return kept.select(F.when(F.col("key") < LAST, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept_text")
