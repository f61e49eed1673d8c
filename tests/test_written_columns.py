from factweave.operators.ordered import previous_row
from factweave.plans.analysis import run_analysis


def test_only_wanted_columns_of_findings_are_worked_out(spark, make_facts):
    facts = make_facts({"document_id": "p", "norm_value": 100.0}, {"document_id": "q", "norm_value": 200.0})
    whole = run_analysis(facts)
    part = run_analysis(facts, columns=["category", "fact_ids"])
    assert part.columns == ["category", "fact_ids", "explanation", "status"]
    assert "description" not in part._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.select("category", "fact_ids").collect()))
    assert rows(part) == rows(whole) and rows(part)


def test_small_groups_are_shuffled_once_and_large_ones_give_the_same(spark):
    df = spark.range(200).selectExpr("cast(id % 7 as string) as g", "id div 50 as s", "id")
    found = lambda small: previous_row(df, ["g"], ["s"], ["s", "id"], ["id"], small=small)
    assert found(1000)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    expected = sorted((str(i % 7), i // 50, i, i - 7 if i >= 7 else None) for i in range(200))
    for small in (1000, 28, 1):  # none, some and all groups are large
        rows = [(r["g"], r["s"], r["id"], r["previous"] and r["previous"]["id"]) for r in found(small).collect()]
        assert sorted(rows, key=lambda r: r[:3]) == expected
