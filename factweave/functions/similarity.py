"""String similarity in Arrow batches: bit-parallel subsequences, seeds where a text is long."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: letters of the seeds that a quote and a stretch of text must share
SEED = 3


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def _common(masks: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of b and the text of `masks`, in one pass over b."""
    row = full = (1 << size) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common(_masks(a), len(a), b) / total


def _sorted_ratio(a: str, b: str) -> float:
    return _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _seeds(codes: np.ndarray) -> np.ndarray:
    """A number for each stretch of SEED letters."""
    if len(codes) < SEED:
        return np.zeros(0, np.int64)
    found = codes[: len(codes) - SEED + 1].copy()
    for k in range(1, SEED):
        found = (found << 21) | codes[k : len(codes) - SEED + 1 + k]
    return found


def _promising(short: str, long: str, cutoff: float) -> np.ndarray:
    """Ends of the windows of `long` that share enough seeds with `short` to reach the cutoff.

    A window of L letters needs L(ratio) = cutoff/200 x (m + L) letters in common with the m
    letters. Each letter of the window that is left out breaks SEED of its L - SEED + 1 seeds at
    most, each one of the short text SEED - 1; the seeds not broken are seeds of the short text.
    """
    m, n = len(short), len(long)
    ends = np.arange(1, n + m)
    sizes = np.minimum(ends, m) - np.maximum(0, ends - n)
    shared = cutoff / 200 * (m + sizes)
    need = sizes - SEED + 1 - SEED * (sizes - shared) - (SEED - 1) * (m - shared)
    possible = sizes >= shared - 1e-9
    if cutoff <= 0 or not (need[possible] > 0).any():
        return ends[possible]
    known = np.isin(_seeds(_codes(long)), np.unique(_seeds(_codes(short))))
    before = np.concatenate(([0], np.cumsum(known)))
    first, last = np.maximum(0, ends - m), np.minimum(ends, n)
    first = np.minimum(first, len(before) - 1)
    count = before[np.maximum(np.minimum(last - SEED + 1, len(before) - 1), first)] - before[first]
    return ends[possible & (count >= need - 1e-9)]


def best_partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """Best ratio of the shorter text against any window of its length in the longer one, also
    those that hang over an end. Below the cutoff 0 stands for it.

    Windows without enough common seeds are not looked at. One more letter in the window
    makes the common subsequence one longer at most: after a window that falls short by k letters
    the next k - 1 can't do better either and are skipped.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if not m:
        return 100.0 if not n else 0.0
    if short in long:
        return 100.0
    masks, best, free = _masks(short), 0.0, 0
    for end in _promising(short, long, cutoff).tolist():
        if end < free:
            continue
        window = long[max(0, end - m) : min(end, n)]
        common = _common(masks, m, window)
        ratio = 200.0 * common / (m + len(window))
        best = max(best, ratio)
        # the window k ends on shares at most common + k; those over an end are shorter
        full = end >= m and end + 1 <= n
        goal = max(best, cutoff)
        if full and ratio < goal:
            free = end + max(1, int(np.ceil(goal * (2 * m) / 200.0 - common - 1e-9)))
            free = min(free, n + 1)
    return best if best >= cutoff else 0.0


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0..100 similarity of two texts with their words sorted; null where either is null."""
    return pd.Series([None if x is None or y is None else _sorted_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def partial_ratio(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """0..100 similarity of the shorter text to the best stretch of the longer one; 0 below the cutoff."""

    @F.pandas_udf(T.DoubleType())
    def best(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else best_partial_ratio(s, t, cutoff) for s, t in zip(x, y)], dtype="float64")

    return best(a, b)
