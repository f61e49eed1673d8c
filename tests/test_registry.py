from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = ["period_swings", "zscore_outliers", "missing_disclosures", "normalize_periods", "evidence_dedup", "reading_order", "citations", "vector_topk",
         "stream_dedup", "stream_dedup_watermark", "stream_admission", "markdown_blocks", "quote_check", "safe_decimals", "dimension_upsert", "dimension_upsert_table",
         "fact_lookup", "compatibility_views", "relation_counts", "nearest_label"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    found = entry.queries()[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(names)
    rows = found.select(*names).collect()
    assert sorted(repr(tuple(r)) for r in rows) == expected and expected
