"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised to words: A-Z in lower case, a word is a run of ASCII letters, digits and
characters beyond ASCII. The patterns are all windows of `width` consecutive words of an item
field (question, answer); a field of fewer words, but not none, is one pattern. Words are the
automaton's letters: a word of some item is one character, every other word is OTHER. A text
is scanned once; each hit is a stretch of words, mapped to code points of the original text.

The windows are counted before they are collected: up to BLOCK_WINDOWS of them make the one
automaton that the tasks get. A larger set of items is dealt to blocks by hash, one automaton
each, and the hits of a text are put together; the results are the same.

Defined results: a null or empty text, and one without words, has no hit; so has every text if
there are no items. Items of a null id hit words, but are neither counted nor listed. Rows of
one item id are one item. Repeated rows of documents each get a result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factweave.llm.common import bound_batches, numbered, steps
from factweave.session import write_through

WIDTH = 10
#: pairs of a window and an item in one automaton; about a million nodes
BLOCK_WINDOWS = 50_000
#: stands for a word that no item has
OTHER = "\x01"
NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
FOUND = "n_words bigint, spans array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items array<string>"


def normalised(text: str) -> bytes:
    """The text in UTF-8 with A-Z in lower case and spaces for all that is in no word; offsets stay."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL)


def windows(items: DataFrame, fields: tuple[str, ...] = ("text",), width: int = WIDTH) -> DataFrame:
    """Distinct (window, item) of the item rows; window is its words joined by a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches):
            found, ids = [], batch.column(1).to_pylist()
            for text, item in zip(texts, ids):
                words = normalised(text).decode("utf-8", "surrogatepass").split(" ")
                words = [w for w in words if w]
                found += [(" ".join(words[k : k + width]), item) for k in range(max(len(words) - width, 0) + 1 if words else 0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["window", "item"])

    texts = [items.select(F.col(f).alias("text"), F.col("item_id").cast("string").alias("item")) for f in fields]
    every = texts[0]
    for more in texts[1:]:
        every = every.unionByName(more)
    return every.mapInArrow(run, "window string, item string").distinct()


class Automaton:
    """Finds the windows of (window, item) pairs in texts."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        of: dict[str, list[str]] = {}
        for window, item in pairs:
            own = of.setdefault(window, [])
            if item is not None:
                own.append(item)
        vocabulary = dict.fromkeys(w for window in of for w in window.split(" "))
        # characters from 2 on, without the surrogates
        self.letters = {w.encode("utf-8", "surrogatepass"): chr(k if k < 0xD800 else k + 0x800) for k, w in enumerate(vocabulary, 2)}
        self.items = list(of.values())
        self.sizes = [window.count(" ") + 1 for window in of]
        self.machine = ahocorasick.Automaton()
        for number, window in enumerate(of):
            self.machine.add_word("".join(self.letters[w.encode("utf-8", "surrogatepass")] for w in window.split(" ")), number)
        if of:
            self.machine.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """(words, stretches of hit words (first, last, start, end), items): `start` and `end`
        are code points of the text, `end` is the one after the stretch."""
        plain = normalised(text)
        words = plain.split()
        if not self.sizes or not words:
            return len(words), [], []
        letter = self.letters.get
        stretches: list[list[int]] = []
        hit: set[int] = set()
        for last, number in self.machine.iter("".join([letter(w, OTHER) for w in words])):
            hit.add(number)
            first = last - self.sizes[number] + 1
            while stretches and stretches[-1][1] >= first - 1:
                first = min(first, stretches.pop()[0])
            stretches.append([first, last])
        if not hit:
            return len(words), [], []
        bytes_at = np.array([m.span() for m in re.finditer(rb"[^ ]+", plain)], np.int64)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
        spans = [(a, b, int(points[bytes_at[a, 0]]), int(points[bytes_at[b, 1]])) for a, b in stretches]
        return len(words), spans, sorted({i for number in hit for i in self.items[number]})


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping or neighbouring stretches as one."""
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            a = out.pop()
            s = (a[0], max(a[1], s[1]), a[2], max(a[3], s[3]))
        out.append(s)
    return out


def _batch(carried: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])
    spans = pa.array([[dict(zip(("first", "last", "start", "end"), s)) for s in f[1]] for f in found], pa.list_(span))
    return pa.RecordBatch.from_arrays(
        [carried, pa.array([f[0] for f in found], pa.int64()), spans, pa.array([f[2] for f in found], pa.list_(pa.string()))],
        names=["carried", "n_words", "spans", "items"])


#: the automaton that this worker built last
_BUILT: dict[str, Automaton] = {}


def _built(name: str, shared) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(shared.value)
    return _BUILT[name]


def _scan(rows: DataFrame, pairs: DataFrame, hits_only: bool = False) -> DataFrame:
    """(carried, n_words, spans, items) of rows (text, carried) with one automaton."""
    shared = rows.sparkSession.sparkContext.broadcast([(p.window, p.item) for p in pairs.collect()])
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(name, shared)
        for batch, texts in steps(batches):
            found = [automaton.scan(t) for t in texts]
            out = _batch(batch.column(1), found)
            yield out.filter(pa.array([bool(f[1]) for f in found])) if hits_only else out

    carried = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(run, f"carried {carried}, {FOUND}")


def scan(docs: DataFrame, items: DataFrame, text: Column, carried: Column, fields: tuple[str, ...] = ("text",),
         width: int = WIDTH, block: int = BLOCK_WINDOWS) -> DataFrame:
    """A row per document: carried (a struct), n_words, the hit `spans` and the `items` found,
    in the order of their ids as strings."""
    bound_batches(docs.sparkSession)
    pairs = write_through(windows(items, fields, width), "benchmark-windows")
    blocks = -(-pairs.count() // block) or 1
    rows = docs.select(text.alias("text"), carried.alias("carried"))
    if blocks == 1:
        return _scan(rows, pairs)
    held = numbered(rows, "scanned-rows")
    short = held.select(F.col("record.text").alias("text"), F.struct("row_no").alias("carried"))
    number = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    found = _scan(short, pairs.filter(number == 0))
    for k in range(1, blocks):
        found = found.unionByName(_scan(short, pairs.filter(number == k), hits_only=True))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield _batch(batch.column(0), [
                (n, merged([tuple(s.values()) for part in p for s in part]), sorted({i for part in o for i in part}))
                for n, p, o in zip(batch.column(1).to_pylist(), spans, own)])

    parts = found.groupBy(F.col("carried.row_no").alias("row_no")).agg(
        F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    whole = parts.join(held, "row_no").select(F.col("record.carried").alias("carried"), "n_words", "spans", "items")
    return whole.mapInArrow(join, f"carried {held.schema['record'].dataType['carried'].dataType.simpleString()}, {FOUND}")


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontaminated(docs: DataFrame, items: DataFrame, share: float = 0.0, **options) -> DataFrame:
    """The documents of which at most that share of words is hit, with all their columns."""
    found = scan(docs, items, docs["text"], F.struct(*[docs[f"`{c}`"] for c in docs.columns]), **options)
    return found.filter(hit_words(F.col("spans")) <= F.col("n_words") * F.lit(share)).select("carried.*")
