"""Periodic runs of words by a sparse diagonal dynamic program.

Words are the maximal stretches without white space (space, U+0009 to U+000D). A run is a
maximal stretch with smallest period q (words q apart are identical) of at least
max(12, 2*q) words. In the table of all word pairs (i, j) a run of period d is a diagonal of
lag d = j - i with at least max(d, 12 - d) matches one after another.

The text is scanned from its start. At each step the earlier occurrences of what stands there
open the lags they lie at or go on with them: an active lag's match length grows by the step,
and a lag that isn't met again ends its diagonal, which gives a run at once if its length
suffices. A diagonal of lags L to 2L - 1 needs L matches, so it holds a whole step of L/2 words
wherever it lies. Hence the program runs once for each power of two L, in steps of L/2 words;
the last few words before the first and after the last step are matched by halves. So the work
is n log n also where one word fills the whole text, and no occurrence is left out.

Stretches of 2^k words are named by 64-bit hashes that are built from those of their halves. A
stretch found at several lags has the least of them as its period, which divides the others.
The documents of a step inside a task stand one after another with a separator of its own
after each; a diagonal across a separator never has as many matches as its lag.

Defined results: a null, empty or white text has no words and no runs; repeated rows each get a
result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from factweave.llm.common import bound_batches, steps

LEAST = 12
FOUND = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i] names the 2^k words from i on; as far as a step of half a lag can need it."""
    names = [_mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]
    while 4 << len(names) <= max(longest, 8) and len(names[-1]) > 1 << (len(names) - 1):
        half = 1 << (len(names) - 1)
        below = names[-1]
        names.append(_mixed(below[:-half] * np.uint64(0xD6E8FEB86659FD93) + below[half:] + np.uint64(len(names))))
    return names


def _diagonals(name: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lag, first, last step) of the diagonals of lags low to high - 1, in steps."""
    here = name[::step]
    before = sliding_window_view(np.concatenate((np.zeros(high - 1, np.uint64), name)), high - low)[::step][: len(here)]
    at, place = np.nonzero(before == here[:, None])  # the earlier occurrences of each step
    lag = high - 1 - place
    real = at * step >= lag
    at, lag = at[real], lag[real]
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    fresh = np.ones(len(at), bool)  # the lag wasn't active at the step before
    fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    ended = np.append(fresh[1:], True) if len(at) else fresh
    return lag[fresh], at[fresh], at[ended]


def find_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, end, period), in order, of the runs of a word sequence (equal numbers are
    equal words); `longest` is the length of the longest document in it."""
    n = len(words)
    names = _names(words, longest)
    found = [np.zeros((0, 3), np.int64)]
    low, high, k = 1, 8, 1
    while k < len(names) and low <= longest // 2:
        step = 1 << k
        lag, first, last = _diagonals(names[k], step, low, high)
        need = np.maximum(lag, LEAST - lag)
        enough = (last - first + 1) * step + 2 * (step - 1) >= need
        lag, need = lag[enough], need[enough]
        begin, end = first[enough] * step, (last[enough] + 1) * step
        for half in range(k - 1, -1, -1):
            name, size = names[half], 1 << half
            more = np.flatnonzero(end + size <= n)
            more = more[name[end[more]] == name[end[more] - lag[more]]]
            end[more] += size
            more = np.flatnonzero(begin - lag >= size)
            more = more[name[begin[more] - size] == name[begin[more] - size - lag[more]]]
            begin[more] -= size
        kept = end - begin >= need
        found.append(np.stack((begin - lag, end, lag), axis=1)[kept])
        low, high, k = high, 2 * high, k + 1
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(texts: list[str]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """Of each text the number of words, its runs (start, length, period) by start and period, and
    the words, joined by a space, that no run holds after its first `period` words."""
    known: dict[bytes, int] = {}
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers = np.empty(int((sizes + 1).sum()), np.int64)
    for k, (own, at) in enumerate(zip(split, starts)):
        numbers[at : at + len(own)] = [known.setdefault(w, len(known)) for w in own]
        numbers[at + len(own)] = -1 - k
    found = find_runs(numbers, int(sizes.max(initial=0)))
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    kept = np.cumsum(change) == 0
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end, period), k in zip(found.tolist(), (np.searchsorted(starts, found[:, 0], "right") - 1).tolist()):
        runs[k].append((start - int(starts[k]), end - start, period))
    left = [b" ".join(w if not r else [w[i] for i in np.flatnonzero(kept[at : at + len(w)]).tolist()]) for w, r, at in zip(split, runs, starts.tolist())]
    return sizes.tolist(), runs, left


def periodic_runs(docs: DataFrame, text: Column, carried: Column) -> DataFrame:
    """A row per document: carried (a struct), n_words, runs and the collapsed text."""
    bound_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            sizes, runs, left = collapse(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array([[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs], run_type), pa.array(left, pa.binary()).cast(pa.string())],
                names=["carried", "n_words", "runs", "collapsed"])

    rows = docs.select(text.alias("text"), carried.alias("carried"))
    return rows.mapInArrow(run, f"carried {rows.schema['carried'].dataType.simpleString()}, {FOUND}")


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
