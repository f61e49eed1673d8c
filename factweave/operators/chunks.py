"""Text blocks: splitting, prioritising, windowing and budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip
from factweave.operators.ordered import first_rows, positions

SHELF = 10_000  # consecutive chunks numbered in one task


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Every line of every text, numbered from 0. A null text has no lines."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


_HEADING = re.compile(r"#{1,6}\s+")
_BLOCK = "reading_order int, chunk_type string, text string, heading string"


def blocks_of(markdown: str) -> list[tuple[int, str, str, str | None]]:
    """(order, type, text, heading above) of the headings, tables and text runs of one text."""
    found: list[tuple[str, str | None, list[str]]] = []
    before, last, heading = "", None, None
    for line in markdown.split("\n"):
        trimmed = line.strip()
        mark = _HEADING.match(trimmed)
        if mark:
            run, heading = "heading", trimmed[mark.end():].strip()
        elif trimmed.startswith("|") and trimmed.endswith("|"):
            run = "table"
        elif trimmed:
            run = "text"
        else:  # a blank line belongs to the run before it, but not to a heading
            run = "table" if last == "table" else "text"
        if trimmed:
            last = run
        if mark or run != before:
            found.append((run, heading, []))
        found[-1][2].append(line)
        before = run
    kept = [(run, "\n".join(own).strip(), above) for run, above, own in found]
    kept = [k for k in kept if k[1]]
    return [(n, "ocr_block" if run == "text" else run, text, above) for n, (run, text, above) in enumerate(kept, 1)]


def markdown_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Headings, tables and text runs of markdown, in order, with the heading above them.

    One pass over each text where it lies: nothing is shuffled. A null text has no blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *block) for i, t in enumerate(batch.column(1).to_pylist()) if t is not None for block in blocks_of(t)]
            column = lambda k, kind: pa.array([r[k] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(column(0, pa.int64())), column(1, pa.int32()), column(2, pa.string()), column(3, pa.string()), column(4, pa.string())],
                names=[key, "reading_order", "chunk_type", "text", "heading"])

    rows = documents.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {_BLOCK}")


def transcribed_pages(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Pages sent for transcription with their outcome; a page without a transcript is never lost.

    pages: document_id, page_number. transcripts: the same keys, markdown, error.
    """
    joined = pages.join(transcripts, ["document_id", "page_number"], "left")
    why = F.coalesce(F.concat(F.lit(": "), "error"), F.lit(""))
    failed = F.col("markdown").isNull()
    return joined.select(
        "document_id", "page_number",
        F.when(failed, "failed").otherwise("transcribed").alias("route"),
        F.when(failed, "needs_review").otherwise("ocr").alias("chunk_type"),
        F.when(failed, F.concat(F.lit("[OCR Transcription Failed] Page "), F.col("page_number").cast("string"),
                                F.lit(" could not be transcribed"), why)).otherwise(F.col("markdown")).alias("text"),
        F.when(failed, "OCR Failed").alias("heading"),
    )


def within_budget(scans: DataFrame, budget: int = V.OCR_PAGE_BUDGET) -> DataFrame:
    """Scan pages of each document: the first `budget` keep their route, the rest are skipped.

    Only the last page within the budget is looked up per document; documents are not sorted.
    """
    first = first_rows(scans.select("document_id", "page_number"), ["document_id"], [F.asc("page_number")], budget, "page_number")
    limits = first.groupBy("document_id").agg(F.max("page_number").alias("_last"))
    return scans.join(limits, "document_id").withColumn(
        "route", F.when(F.col("page_number") > F.col("_last"), "skipped").otherwise("scan")).drop("_last")


def chunk_class(chunk_type: Column, text: Column) -> Column:
    """0 tables, 1 text with digits, 2 other text."""
    return F.when(chunk_type == "table", 0).when(F.coalesce(text, F.lit("")).rlike(r"\p{Nd}"), 1).otherwise(2)


def prioritised(chunks: DataFrame, narrative: int = V.NARRATIVE_BUDGET) -> DataFrame:
    """Chunks worth extracting: all tables and numeric text, the first narrative ones, in that order."""
    ranked = chunks.withColumn("priority", chunk_class(F.col("chunk_type"), F.col("text")))
    story = ranked.filter(F.col("priority") == 2)
    kept = ranked.filter(F.col("priority") < 2).unionByName(
        first_rows(story, ["document_id"], [F.asc("reading_order"), F.asc("chunk_id")], narrative, "chunk_id").drop("rank"))
    shelved = kept.withColumn("_shelf", F.floor(F.col("reading_order") / SHELF))
    return positions(shelved, ["document_id"], ["priority", "_shelf"], ["reading_order", "chunk_id"]).drop("_shelf")


def windows(chunks: DataFrame, size: int = V.WINDOW_CHUNKS) -> DataFrame:
    """Consecutive chunks of a document joined into extraction requests of `size` chunks."""
    placed = chunks.withColumn("window", F.floor((F.col("position") - 1) / size).cast("int"))
    prompt = F.concat(
        F.lit("--- CHUNK ID: "), "chunk_id", F.lit(" | Type: "), F.coalesce("chunk_type", F.lit("paragraph")), F.lit(" | Section: "),
        F.coalesce("heading", F.lit("General")), F.lit(" ---\n"), strip(F.coalesce("text", F.lit(""))))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id", prompt.alias("prompt")))), lambda x: x)
    rows = placed.groupBy("document_id", "window").agg(parts.alias("parts"))
    return rows.select(
        "document_id", "window", F.transform("parts", lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.array_join(F.transform("parts", lambda x: x["prompt"]), "\n\n").alias("prompt"))


def route_facts(windows_: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts returned for a window assigned to one of its chunks.

    A fact naming a foreign chunk is dropped, unless the window has a single chunk.
    """
    joined = facts.join(windows_.select("document_id", "window", "chunk_ids"), ["document_id", "window"])
    own = F.array_contains("chunk_ids", F.coalesce("chunk_id", F.lit("")))
    single = F.size("chunk_ids") == 1
    return joined.filter(own | single).withColumn(
        "chunk_id", F.when(own, F.col("chunk_id")).otherwise(F.col("chunk_ids")[0])).drop("chunk_ids")
