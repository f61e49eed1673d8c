"""Chat formatting with offset-aligned loss masks.

A turn is rendered as <|turn|>role<|text|>text<|end|>. The three marks are special tokens of
their own, so no token reaches over the end of a text. Inside roles and texts a backslash is
doubled and "<|" becomes "<\\|", so no text can hold a mark, and the change is undone on reading.
A conversation is rendered whole and encoded once with offsets; the sorted spans of assistant
texts are met with the token spans by binary search.

Rows are dealt by conversation and sorted; a task reads them as a stream. A conversation of more
than SEGMENT_CHARS is rendered in segments that end between turns. A mark ends a token, so the
tokens are the same, and no task ever holds a whole giant conversation.

Defined results: a null text or role counts as empty; an empty text is a turn without loss
tokens; a null turn comes first and a null conv_id is a conversation of its own; equal turn
numbers are ordered by role and text, repeated rows stay; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factweave.llm.common import bound_batches
from factweave.llm.tokens import load

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
SEGMENT_CHARS = 1_000_000
RENDERED = "conv_id bigint, segment int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the output."""
    return [(unescape(m[1]), unescape(m[2])) for m in PARSE.finditer(formatted)]


@lru_cache
def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    load(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (TURN, TEXT, END)])
    return tokenizer


def render(turns: list[tuple[str, str]], path: str, assistant: str = "assistant") -> tuple[str, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The text of some turns with ids, token starts and ends (code points) and the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == assistant and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    formatted = "".join(parts)
    encoded = _tokenizer(path).encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    starts, ends = offsets[:, 0], offsets[:, 1]
    if not spans:
        return formatted, encoded.ids, starts, ends, np.zeros(len(starts), bool)
    first, last = np.array(spans, np.int64).T
    k = np.searchsorted(first, starts, side="right") - 1
    return formatted, encoded.ids, starts, ends, (k >= 0) & (ends <= last[np.maximum(k, 0)])


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of tokens."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], loss.astype(np.int8), [0]))))
    return [unescape(formatted[int(starts[a]) : int(ends[b - 1])]) for a, b in zip(edges[::2], edges[1::2])]


def _runs(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    for batch in frames:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def format_conversations(rows: DataFrame, tokenizer: str, assistant: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) become rendered segments with ids, offsets and loss mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, segment, turns):
            formatted, ids, starts, ends, loss = render(turns, tokenizer, assistant)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([segment], pa.int32()), pa.array([formatted]), pa.array([ids], pa.list_(pa.int32())),
                 *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (starts, ends)], pa.array([loss], pa.list_(pa.bool_()))],
                names=["conv_id", "segment", "formatted", "ids", "starts", "ends", "loss"])

        now, segment, turns, size = None, 0, [], 0
        for key, role, text in _runs(batches):
            if turns and (key != now or size >= SEGMENT_CHARS):
                yield emit(now, segment, turns)
                segment, turns, size = (segment + 1 if key == now else 0), [], 0
            now = key
            turns.append((role or "", text or ""))
            size += len(text or "")
        if turns:
            yield emit(now, segment, turns)

    bound_batches(rows.sparkSession)
    dealt = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, RENDERED)


DIGESTS = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
           "n_tokens bigint, n_loss_tokens bigint")


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered segments (in the order they left the operator)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            done = []
            for r in frame.itertuples(index=False):
                key = None if pd.isna(r.conv_id) else int(r.conv_id)
                if r.segment == 0:
                    if state:
                        done.append(finish(now, state))
                    now, state = key, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "masked": 0}
                for role, text in parse(r.formatted):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for text in loss_text(r.formatted, r.starts, r.ends, r.loss):
                    state["loss"].update(text.encode())
                    state["loss_chars"] += len(text)
                state["chars"] += len(r.formatted)
                state["tokens"] += len(r.ids)
                state["masked"] += int(r.loss.sum())
            yield pd.DataFrame(done, columns=[c.split()[0] for c in DIGESTS.split(", ")])
        if state:
            yield pd.DataFrame([finish(now, state)], columns=[c.split()[0] for c in DIGESTS.split(", ")])

    def finish(key, s):
        return key, s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["masked"]

    return rendered.mapInPandas(run, DIGESTS)
