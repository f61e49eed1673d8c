"""Token ids of many texts with a public tokenizer of byte-level BPE."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np

#: a space between other white space and white space, or the end: such a text isn't cut at spaces
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: distinct pieces that one worker remembers; beyond, those that came only once are forgotten
REMEMBERED = 1_000_000


@lru_cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread in each task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Numbers(dict):
    """Gives a new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Encoder:
    """Ids of whole texts. The tokenizer splits text before a space that stands alone, so a
    text is cut there, each distinct piece is encoded once, and the ids are put together.
    Texts with runs of mixed white space are encoded in one go; the ids are the same either way."""

    def __init__(self, path: str):
        self.path = path
        self.known = _Numbers()
        self.starts, self.lengths, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Drops the pieces that came once."""
        kept = [(p, k) for p, k in self.known.items() if self.uses[k] > 1]
        at = np.fromiter((k for _, k in kept), np.int64, len(kept))
        self.ids, ends = self._put_together(at)
        self.known = _Numbers((p, i) for i, (p, _) in enumerate(kept))
        self.lengths, self.uses = self.lengths[at], np.ones(len(kept), np.int64)
        self.starts = ends - self.lengths

    def _put_together(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and where each ends."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in load(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the pieces that have a number but no ids yet."""
        new = list(islice(self.known, len(self.lengths), None))
        if not new:
            return
        found = self._encode(new)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        self.ids = np.concatenate((self.ids, ids))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        whole, pieces, counts = {}, [], []
        for i, text in enumerate(texts):
            if UNSAFE.search(text):
                whole[i] = text
                counts.append(0)
                continue
            before = len(pieces)
            first, *rest = text.split(" ")
            pieces.append(first)
            pieces += [" " + p for p in rest]
            counts.append(len(pieces) - before)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, ends = self._put_together(at)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        found = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i, x in zip(whole, self._encode(list(whole.values()))):
            found[i] = np.array(x, np.uint32)
        return found
