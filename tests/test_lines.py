from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from factweave.operators import chunks

FOLDER = "/root/testdata/sf0.001"
ON_LINES = ["evidence_dedup", "evidence_integrity", "evidence_chain", "chunk_priority", "chunk_windows", "extraction_routing", "structure_counts"]


def test_lines_keep_blank_ones_and_null_texts_have_none(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n"), (2, None), (3, "")], "id long, body string")
    rows = sorted(map(tuple, chunks.lines(df, "id", "body").collect()))
    assert rows == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (1, 3, ""), (3, 0, "")]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", ON_LINES)
def test_queries_on_lines_equal_sql(spark, name):
    db = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    rows = entry.queries()[name](spark, FOLDER).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in rows) == expected and expected
