from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factweave.plans.analysis import reconcile_document

FOLDER = "/root/testdata/sf0.001"


def test_reconcile_document_has_semantic_pairs(make_facts):
    facts = make_facts(dict(document_id="d1", norm_value=5.0), dict(document_id="d2"), dict(document_id="d2", attribute_canon="sales"),
                       dict(document_id="d3", attribute_canon="costs"), dict(document_id="d3", attribute_canon="sales", entity_canon="other", norm_value=5.0))
    at = F.col("fact_id").substr(2, 3).cast("int")
    vector = F.when(at == 3, F.array(F.lit(0.0), F.lit(1.0))).when(at < 3, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(1.0), F.lit(0.3)))
    facts = facts.withColumn("embedding", vector)
    of = lambda rows: sorted((r.fact_a, r.fact_b) for r in rows.collect())
    every = [("f000", "f001"), ("f000", "f002"), ("f000", "f004"), ("f001", "f002"), ("f001", "f004")]
    first = reconcile_document(facts, None, with_text=False)
    rules = {(r.fact_a, r.fact_b): (r.relation, list(r.rules_applied)) for r in first.collect()}
    assert rules[("f000", "f004")] == ("contextual_variance", ["R2:context_diff:entity"])
    assert of(first) == every  # f002 and f004 are of one attribute and two entities
    assert of(reconcile_document(facts, None, "d1", with_text=False)) == every[:3]
    assert of(reconcile_document(facts, first.filter("fact_b <> 'f004'"), "d3", with_text=False)) == [("f000", "f004"), ("f001", "f004")]
    assert of(reconcile_document(facts.drop("embedding"), None, with_text=False)) == every[:1]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", ["reconcile_semantic", "citations_of_turns"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    rows = entry.queries()[name](spark, FOLDER).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in rows) == expected and expected
