"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.session import new_path, write_table

#: code points of text that one step inside a task handles at once (a longer text is a step of its own)
STEP_CHARS = 2_000_000


#: rows of text in an Arrow batch; Spark's own default of 10,000 is meant for narrow rows
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session small enough for texts, unless it sets their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def steps(batches: Iterator[pa.RecordBatch], text: int = 0) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches into slices of about STEP_CHARS; null texts come out as empty."""
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > STEP_CHARS:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


#: tables written by `numbered` in this process, until `clear_tables` removes them
_TABLES: list[str] = []


def clear_tables(docs: DataFrame) -> None:
    """Removes the tables that `numbered` wrote for earlier steps, once their results have been
    written and read again: those that the plan of `docs` doesn't read any more."""
    files, jvm = docs.inputFiles() if _TABLES else [], docs.sparkSession.sparkContext._jvm
    for path in list(_TABLES):
        if not any(path.rsplit("/", 1)[-1] in f for f in files):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _TABLES.remove(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder as (row_no, record); row_no is unique and stays the
    same however often the table is read, so equal rows can be told apart. `record` holds the
    columns as they came, whatever their names."""
    held = docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"))
    path = new_path(docs.sparkSession, name)
    write_table(held, path)
    _TABLES.append(path)
    return docs.sparkSession.read.schema(held.schema).parquet(path)
