import random

from pyspark.sql import Window, functions as F

from factweave.operators import anomalies, calculations, disclosures, findings, review
from factweave.operators.ordered import first_rows, previous_row
from factweave.plans.analysis import run_analysis


def test_first_digits(make_facts):
    even = make_facts(*[{"norm_value": float(d * 100 + i)} for d in range(1, 10) for i in range(10)])
    row = anomalies.first_digit_check(even).collect()[0]
    assert row["chi_squared"] > 15.5 and row["worst_digits"][0] == 1
    shares = {1: 30, 2: 18, 3: 12, 4: 10, 5: 8, 6: 7, 7: 6, 8: 5, 9: 4}
    fitting = make_facts(*[{"norm_value": float(d)} for d, n in shares.items() for _ in range(n)])
    assert anomalies.first_digit_check(fitting).count() == 0
    assert anomalies.first_digit_check(make_facts(*[{"norm_value": 9.0}] * 19)).count() == 0


def test_zscores(make_facts):
    rows = [{"norm_value": 100.0 + i % 3} for i in range(10)] * 2 + [{"norm_value": 1000.0, "fact_id": "odd"}]
    found = anomalies.zscore_outliers(make_facts(*rows)).collect()
    assert [r["fact_id"] for r in found] == ["odd"]
    assert anomalies.zscore_outliers(make_facts({"norm_value": 1.0}, {"norm_value": 9.0})).count() == 0


def test_swings_and_changes(make_facts):
    up = make_facts({"norm_value": 100.0, "period": "FY2022"}, {"norm_value": 200.0, "period": "FY2023"})
    assert anomalies.period_swings(up).collect()[0]["severity"] == "medium"
    change = findings.period_change_findings(anomalies.period_changes(up)).collect()[0]
    assert "100.0%" in change["title"] and "increased" in change["title"] and change["severity"] == "high"
    assert "increase requires" in change["description"]
    assert anomalies.period_changes(make_facts({"norm_value": 100.0, "period": "FY2022"}, {"norm_value": 130.0, "period": "FY2023"})).count() == 0
    down = make_facts({"norm_value": 200.0, "period": "FY2022"}, {"norm_value": 50.0, "period": "FY2023"})
    assert anomalies.period_changes(down).collect()[0]["direction"] == "decreased"
    assert anomalies.period_changes(make_facts({"norm_value": 0.0, "period": "FY2022"}, {"norm_value": 50.0, "period": "FY2023"})).count() == 0


def test_previous_row_equals_plain_lag(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), rnd.choice("xyz"), rnd.randrange(4), rnd.randrange(3), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, s string, t int, u int, v double")
    got = previous_row(df, ["g"], ["s", "t", "u"], ["s", "t", "u", "id"], ["id", "v"])
    plain = df.withColumn("expected", F.lag("id").over(Window.partitionBy("g").orderBy("s", "t", "u", "id")))
    joined = got.join(plain.select("id", "expected"), "id")
    assert joined.count() == 300 and joined.filter(~F.col("previous.id").eqNullSafe(F.col("expected"))).count() == 0


def test_first_rows_equal_plain_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 37 % 101).alias("o"))
    got = {(r["g"], r["id"]) for r in first_rows(df, ["g"], [F.desc("o"), F.col("id")], 7, "id", salts=8).collect()}
    w = Window.partitionBy("g").orderBy(F.desc("o"), "id")
    assert got == {(r["g"], r["id"]) for r in df.withColumn("r", F.row_number().over(w)).filter("r <= 7").collect()}


def test_cross_footing(make_facts):
    facts = make_facts({"attribute_canon": "current_assets", "norm_value": 40.0}, {"attribute_canon": "Non current assets", "norm_value": 50.0},
                       {"attribute_canon": "total_assets", "norm_value": 120.0, "fact_id": "t"})
    row = anomalies.cross_foot_check(facts).collect()[0]
    assert (row["severity"], row["computed_sum"], row["fact_id"]) == ("critical", 90.0, "t")
    converted = anomalies.as_findings(anomalies.run_checks(facts)).collect()
    assert [c["category"] for c in converted] == ["computational_error"]


def test_last_statement_of_a_metric_wins(make_facts):
    facts = make_facts({"attribute_canon": "current_assets", "norm_value": 1.0, "page_number": 1}, {"attribute_canon": "current_assets", "norm_value": 40.0, "page_number": 2},
                       {"attribute_canon": "non_current_assets", "norm_value": 60.0}, {"attribute_canon": "total_assets", "norm_value": 100.0})
    assert anomalies.cross_foot_check(facts).count() == 0


def test_missing_disclosures(spark):
    sets = spark.createDataFrame([("acme", "FY2024", "p", "p.pdf", ["ebitda", "net_income", "total_revenue", "headcount"]), ("acme", "FY2024", "q", "q.pdf", ["total_revenue"])],
                                 "entity_canon string, period string, document_id string, filename string, metrics array<string>")
    rows = disclosures.missing_disclosures(sets).collect()
    assert {(r["document_id"], r["missing_metric"], r["present_in"]) for r in rows} == {("q", "ebitda", "p.pdf"), ("q", "net_income", "p.pdf")}
    assert {f["category"] for f in disclosures.as_findings(disclosures.missing_disclosures(sets)).collect()} == {"missing_disclosure"}


def test_analysis_runs_every_part(make_facts):
    facts = make_facts({"document_id": "p", "norm_value": 100.0}, {"document_id": "q", "norm_value": 40.0},
                       {"document_id": "q", "attribute_canon": "ebitda", "norm_value": 1.0},
                       {"document_id": "p", "norm_value": 500.0, "period": "FY2025"})
    found = run_analysis(facts)
    counts = {r["category"]: r["n_findings"] for r in findings.counts_by_category(found).collect()}
    # p misses ebitda, a tie-out contradiction, changes over time, and a swing inside p
    assert counts["missing_disclosure"] == 1 and counts["contradiction"] == 1 and counts["anomaly"] == 3
    ids = [r["finding_id"] for r in found.collect()]
    assert len(set(ids)) == len(ids) == run_analysis(facts).select("finding_id").distinct().count()
    assert run_analysis(facts, document_ids=["p"]).filter("category = 'missing_disclosure'").count() == 0


def calc(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_calculations(make_facts, spark):
    facts = make_facts(*[{"fact_id": f"v{v}", "norm_value": float(v)} for v in (0, 50, 80, 100, 120, 200)], {"fact_id": "none"})
    growth = calculations.calculate_growth(calc(spark, [("1", "v120", "v100"), ("2", "v80", "v100"), ("3", "v80", "v0"), ("4", "v80", "none")],
                                                "calc_id string, current_id string, previous_id string"), facts)
    by = {r["calc_id"]: r for r in growth.collect()}
    assert [None if by[i]["result"] is None else float(by[i]["result"]) for i in "1234"] == [20.0, -20.0, None, None]
    assert "zero" in by["3"]["error"] and by["4"]["error"] == "Missing input values"
    ratio = calculations.calculate_ratio(calc(spark, [("1", "ratio", "v50", "v200"), ("2", "net_profit_margin", "v50", "v200"), ("3", "ratio", "v50", "v0")],
                                              "calc_id string, formula_name string, numerator_id string, denominator_id string"), facts)
    by = {r["calc_id"]: r for r in ratio.collect()}
    assert (float(by["1"]["result"]), by["1"]["result_unit"]) == (0.25, "ratio")
    assert (float(by["2"]["result"]), by["2"]["result_unit"]) == (25.0, "pct")
    assert by["3"]["error"] == "Division by zero"
    foot = calculations.cross_foot(calc(spark, [("1", ["v50", "v50"], "v100"), ("2", ["v50", "none"], "v120"), ("3", ["none"], "v120")],
                                        "calc_id string, line_item_ids array<string>, total_id string"), facts)
    by = {r["calc_id"]: r for r in foot.collect()}
    assert by["1"]["is_verified"] and float(by["1"]["result"]) == 100.0
    assert not by["2"]["is_verified"] and by["2"]["error"].startswith("Mismatch")
    assert by["3"]["error"] == "Missing input values"
    stored = growth.unionByName(ratio).unionByName(foot)
    assert calculations.verify(stored, facts).filter("not verified").count() == 0
    changed = facts.withColumn("norm_value", F.when(F.col("fact_id") == "v50", 60.0).otherwise(F.col("norm_value")))
    broken = {(r["formula_id"], r["calc_id"]) for r in calculations.verify(stored, changed).filter("not verified").collect()}
    assert broken == {("ratio", "1"), ("ratio", "2"), ("cross_foot", "1"), ("cross_foot", "2")}
    assert calculations.calculations_of_fact(stored, "v120").count() == 3


def test_own_formula(make_facts):
    facts = make_facts({"attribute_canon": "net debt", "norm_value": 30.0}, {"attribute_canon": "ebitda", "norm_value": 12.0})
    row = calculations.evaluate_formulas(facts, {"leverage": "net_debt / ebitda"}).collect()[0]
    assert (row["formula_name"], float(row["result"]), row["error"]) == ("leverage", 2.5, None)


def test_review_queue(make_facts, spark):
    facts = make_facts({"confidence": 0.3}, {"confidence": 0.0}, {"confidence": 0.9})
    odd = spark.createDataFrame([("f002", "d1", "zscore", "x"), ("f002", "d1", "zscore", "y"), (None, "d1", "benford", "z")],
                                "fact_id string, document_id string, anomaly_type string, description string")
    stored = spark.createDataFrame([("r1", "f000", "contradicts"), ("r2", "f000", "contradicts"), ("r3", "f001", "corroborates")],
                                   "relation_id string, fact_a string, relation string")
    items = review.review_items(odd, facts, stored)
    assert {(r["fact_id"], r["reason"]) for r in items.collect()} == {("f002", "anomaly:zscore"), ("f000", "low_confidence"), ("f000", "contradiction")}
    again = review.review_items(odd, facts, stored, items)
    assert again.count() == 0
    pending = items.withColumn("status", F.when(F.col("reason") == "contradiction", "approved").otherwise(F.col("status")))
    assert [r["reason"] for r in review.review_items(odd, facts, stored, pending).collect()] == ["contradiction"]
    counts = {r["status"]: r["n_items"] for r in review.stats(pending).collect()}
    assert counts == {"pending": 2, "approved": 1, "rejected": 0, "deferred": 0, "total": 3}


def test_findings_order_filter_and_decisions(spark):
    rows = [("1", "anomaly", "low", ["p"], "open"), ("2", "contradiction", "critical", ["p", "q"], "open"), ("3", "contradiction", "info", ["q"], "dismissed")]
    table = spark.createDataFrame(rows, "finding_id string, category string, severity string, document_ids array<string>, status string")
    assert [r["finding_id"] for r in findings.ranked(table).collect()] == ["2", "1", "3"]
    assert [r["finding_id"] for r in findings.select_findings(table, category="contradiction", document_id="q", status="open").collect()] == ["2"]
    total = {r["category"]: r["total"] for r in findings.summary(table).collect()}
    assert total == {"anomaly": 1, "contradiction": 1, "total": 2}
    decisions = spark.createDataFrame([("1", "resolved", 1), ("1", "nonsense", 2), ("2", "dismissed", 1)], "finding_id string, status string, decided_at int")
    after = findings.apply_decisions(table, decisions.filter("decided_at = 1"), "finding_id", {"status": ["open", "resolved", "dismissed"]})
    assert {r["finding_id"]: r["status"] for r in after.collect()} == {"1": "resolved", "2": "dismissed", "3": "dismissed"}


def test_positions_and_carried_values_equal_plain_windows(spark):
    from factweave.operators.ordered import carry_forward, positions

    rnd = random.Random(8)
    rows = [(i, rnd.choice("ab"), rnd.randrange(3), rnd.randrange(4), rnd.choice([None, None, f"h{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, s int, t int, h string")
    w = Window.partitionBy("g").orderBy("s", "t", "id")
    plain = df.select("id", F.row_number().over(w).alias("n"), F.last("h", True).over(w).alias("c"))
    order = ["s", "t", "id"]
    got = carry_forward(positions(df, ["g"], ["s", "t"], order), ["g"], ["s", "t"], order, "h", "carried").join(plain, "id")
    assert got.count() == 200
    assert got.filter((F.col("position") != F.col("n")) | ~F.col("carried").eqNullSafe(F.col("c"))).count() == 0


def test_calculations_take_any_scale(spark, make_facts):
    facts = make_facts(*[dict(fact_id=k, norm_value=v) for k, v in
                         [("t6", 0.00006), ("t4", 0.00004), ("b2", 2e18), ("b1", 1e18), ("e20", 2e-20), ("e21", 1e-20), ("z", 0.0), ("n", -7.5), ("third", 3.0)]])
    ask = [("1", "ratio", "t6", "t4"), ("2", "ratio", "b2", "b1"), ("3", "ratio", "e20", "e21"), ("4", "ratio", "b1", "z"), ("5", "ratio", "n", "third"),
           ("6", "ratio", "e20", "b1"), ("7", "ratio", "b1", "e20"), ("8", "ratio", "t4", "none")]
    got = {r.calc_id: (r.result, r.error) for r in calculations.calculate_ratio(spark.createDataFrame(ask, "calc_id string, formula_name string, numerator_id string, denominator_id string"), facts).collect()}
    assert [float(got[k][0]) for k in "1235"] == [1.5, 2.0, 2.0, -2.5]
    assert got["4"] == (None, "Division by zero") and got["8"] == (None, "Missing input values") and got["7"] == (None, "Value out of range")
    assert float(got["6"][0]) == 0.0
    growth = calculations.calculate_growth(spark.createDataFrame([("1", "t6", "t4"), ("2", "b2", "b1")], "calc_id string, current_id string, previous_id string"), facts)
    assert {r.calc_id: float(r.result) for r in growth.collect()} == {"1": 50.0, "2": 100.0}
    foot = calculations.cross_foot(spark.createDataFrame([("1", ["b1", "b1"], "b2"), ("2", ["t6", "t4"], "t4")], "calc_id string, line_item_ids array<string>, total_id string"), facts)
    assert {r.calc_id: r.is_verified for r in foot.collect()} == {"1": True, "2": False}


def test_period_changes_with_one_common_start_of_ids(make_facts):
    names = [f"statement-of-the-year-{i:03d}" for i in range(300)]
    facts = make_facts(*[{"document_id": d, "norm_value": float(2 ** (i % 3) * 100), "period": f"FY{2000 + i % 4}"} for i, d in enumerate(names)])
    shelves = anomalies._with_shelf(facts).select("_shelf").distinct().count()
    assert shelves > 100
    order = sorted((f"FY{2000 + i % 4}", d, float(2 ** (i % 3) * 100)) for i, d in enumerate(names))
    want = sum(abs(b[2] - a[2]) / a[2] > 0.5 for a, b in zip(order, order[1:]))
    assert anomalies.period_changes(facts).count() == want > 50
