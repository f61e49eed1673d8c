"""What incremental reconciliation leaves on the disk: facts and relations without what follows from them."""

from pathlib import Path

from factweave.operators.pairs import pair_up
from factweave.operators.reconcile import apply_rules, as_relations
from factweave.session import new_path
from factweave.streaming import jobs

KEYS = ["entity_canon", "attribute_canon"]


def test_ids_are_worked_out_and_working_tables_go(spark, make_facts):
    facts = make_facts(*[{"document_id": "pq"[i % 2], "norm_value": float(i % 3) if i % 4 else None, "raw_value": "resigned"} for i in range(12)])
    path, home = new_path(spark, "facts"), new_path(spark, "home")
    facts.repartition(3, "fact_id").write.parquet(path)
    rows = jobs.incremental_reconciliation(jobs.file_stream(spark, path, facts.schema, files_per_batch=1), KEYS, home)
    listed = as_relations(apply_rules(pair_up(facts, KEYS), explain=False))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, listed.select(*rows.columns).collect())) and rows.columns[0] == "relation_id"
    assert "relation_id" not in spark.read.parquet(f"{home}/relations").columns
    shared = Path(home).parent
    assert not [f for kind in ("arrived-facts", "earlier-facts") for f in shared.glob(f"{kind}-*/*.parquet")]
