import duckdb
from pathlib import Path

import __spark_entry__ as entry


def test_findings_shuffle_nothing_once_written_and_equal_sql(spark):
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = entry.queries()["findings_all"](spark, folder)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    result = db.execute(entry.oracle_sql()["findings_all"])
    names = [c[0] for c in result.description]
    assert sorted(repr(tuple(r)) for r in found.select(*names).collect()) == sorted(map(repr, result.fetchall()))
