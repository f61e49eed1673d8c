import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from factweave.operators import counting, pairs, reconcile, relations, tieouts
from factweave.plans.analysis import reconcile_audit, reconcile_document

KEYS = ["entity_canon", "attribute_canon"]


def random_facts(make_facts, n=120, seed=3):
    rnd = random.Random(seed)
    return make_facts(*[
        {
            "document_id": rnd.choice("pqr"), "entity_canon": rnd.choice(["hot", "hot", "hot", "x", "y"]), "attribute_canon": rnd.choice(["m", "n"]),
            "norm_value": rnd.choice([10.0, 10.05, 20.0, 0.5, 50.0]), "period": rnd.choice(["FY2020", "FY2021", "fy2021", None, ""]),
            "currency": rnd.choice(["USD", "INR", None, "XXX"]), "norm_unit": rnd.choice(["currency", "currency", "pct", "count"]),
            "scope": rnd.choice([None, "standalone", "consolidated"]), "confidence": rnd.choice([0.9, 0.9, 0.9, 0.4, 0.0]),
        } for _ in range(n)])


def ids(df, a="a_fact_id", b="b_fact_id"):
    return sorted((r[a], r[b]) for r in df.select(a, b).collect())


def test_blocks_give_every_pair_once(make_facts):
    facts = random_facts(make_facts)
    rows = facts.collect()
    expected = sorted((a["fact_id"], b["fact_id"]) for a, b in itertools.combinations(rows, 2) if all(a[k] == b[k] for k in KEYS))
    for block_rows in (4, 7, 1000):
        assert ids(pairs.pair_up(facts, KEYS, block_rows=block_rows)) == expected
    with_self = pairs.pair_up(facts, KEYS, block_rows=5, with_self=True)
    assert ids(with_self) == sorted(expected + [(r["fact_id"], r["fact_id"]) for r in rows])


def test_across_gives_every_combination(make_facts):
    facts = random_facts(make_facts)
    left, right = facts.filter(F.col("document_id") == "p"), facts.filter(F.col("document_id") != "p")
    expected = sorted((a["fact_id"], b["fact_id"]) for a in left.collect() for b in right.collect() if all(a[k] == b[k] for k in KEYS))
    for block_rows in (3, 1000):
        assert ids(pairs.pair_across(left, right, KEYS, block_rows)) == expected


def test_known_pairs_are_left_out_in_both_directions(make_facts, spark):
    facts = make_facts({}, {}, {}, {"document_id": "d2"})
    known = spark.createDataFrame([("f001", "f000"), ("f001", "f002")], "fact_a string, fact_b string")
    assert ids(pairs.exact_candidates(facts, known)) == [("f000", "f002"), ("f000", "f003"), ("f001", "f003"), ("f002", "f003")]
    assert ids(pairs.exact_candidates(facts, cross_document_only=True, document_id="d2")) == [("f000", "f003"), ("f001", "f003"), ("f002", "f003")]


def test_counts_without_listing_equal_listed_counts(make_facts):
    facts = random_facts(make_facts, 150)
    listed = reconcile.apply_rules(pairs.pair_up(facts, KEYS), with_text=False, explain=False)
    expected = {r["relation"]: r["count"] for r in listed.groupBy("relation").count().collect()}
    counted = {r["relation"]: r["n_pairs"] for r in counting.relation_counts(facts).collect()}
    assert counted == expected


def test_counts_per_group_with_texts_and_odd_numbers(make_facts):
    rnd = random.Random(8)
    kinds = [("pct", None), ("count", None), (None, None), ("currency", "USD"), ("currency", "INR"), (None, "USD"), ("currency", "XXX")]
    facts = make_facts(*[
        {
            **dict(zip(("norm_unit", "currency"), rnd.choice(kinds))),
            "entity_canon": rnd.choice(["hot", "hot", "x"]), "norm_value": rnd.choice([None, 0.0, -0.0, 99.0, 100.0, 101.0, -99.0, -100.0, 1.0, 0.99, float("nan"), float("inf")]),
            "period": rnd.choice(["FY2020", "fy2020 ", None]),
            "raw_value": rnd.choice(["he resigned", "he continues", "resigned and continues", "he resigned"]), "confidence": rnd.choice([0.9, 0.0, 0.4]),
        } for _ in range(160)], *[{"entity_canon": "tiny", "norm_value": v} for v in (0.0, 1e-12, 1e-11, 1e-10, 1e-9, 1.005e-9, 2e-9)])
    listed = reconcile.apply_rules(pairs.pair_up(facts, KEYS), explain=False)
    expected = {(r["entity_canon"], r["relation"]): r["count"] for r in listed.groupBy("entity_canon", "relation").count().collect()}
    counted = {(r["entity_canon"], r["relation"]): r["n_pairs"] for r in counting.relation_counts(facts, ["entity_canon"]).collect()}
    assert counted == expected
    ledger = reconcile.relation_ledger(facts).groupBy("entity_canon", "relation").agg(F.sum("n_pairs").alias("n")).collect()
    assert {(r["entity_canon"], r["relation"]): r["n"] for r in ledger} == expected


def test_a_hot_period_is_counted_without_pairs(spark, make_facts):
    n = 50_000
    one = make_facts({})
    facts = spark.range(n).join(one.drop("fact_id", "norm_value")).select(
        F.format_string("f%05d", "id").alias("fact_id"), (F.lit(1000.0) + F.col("id") * 0.37).alias("norm_value"), *[c for c in one.columns if c not in ("fact_id", "norm_value")])
    values = 1000.0 + np.arange(n) * 0.37
    within = 0
    for i, high in enumerate(np.searchsorted(values, values / 0.99 + 1e-7, "right")):
        while (values[high - 1] - values[i]) / values[high - 1] > 0.01:
            high -= 1
        within += int(high) - i - 1
    got = counting.relation_counts(facts)
    assert {r["relation"]: r["n_pairs"] for r in got.collect()} == {"corroborates": within, "contradicts": n * (n - 1) // 2 - within}


def test_prefix_sums_over_ranges(spark):
    rows = [("a", i % 50, 1 + i % 3) for i in range(2000)] + [("b", 3, 7)]
    df = spark.createDataFrame(rows, "k string, at int, w bigint")
    want = {(k, at): sum(w for kk, a, w in rows if kk == k and a <= at) for k, at, _ in rows}
    assert {((r.k, r.at), r.total) for r in counting.prefix_sums(df, ["k"], ["at"], "w", "total").collect()} == set(want.items())


def test_reconciling_twice_adds_nothing(make_facts):
    facts = random_facts(make_facts, 40)
    first = reconcile_document(facts, None, with_text=False)
    assert first.count() > 0
    assert reconcile_document(facts, first, with_text=False).count() == 0
    audit = reconcile_audit(first)
    assert audit.count() == first.count() and set(audit.columns) == {"at", "actor", "action", "target", "meta", "day"}


def test_matrix_badge_precedence(make_facts, spark):
    facts = make_facts({}, {}, {"attribute_canon": "ebitda"}, {"attribute_canon": "pbt"}, {"attribute_canon": "pbt"})
    stored = spark.createDataFrame([("f000", "f001", "corroborates"), ("f001", "f002", "needs_review"), ("f000", "f002", "contextual_variance")],
                                   "fact_a string, fact_b string, relation string")
    cells = {r["attribute_canon"]: (r["n_facts"], r["badge"]) for r in relations.entity_matrix(facts, stored).collect()}
    assert cells == {"total_revenue": (2, "contextual_variance"), "ebitda": (1, "contextual_variance"), "pbt": (2, None)}


def brute_tieouts(rows):
    upper = lambda r: (r["period"] or "").strip().upper()
    stated = {}
    for r in rows:
        if upper(r):
            stated.setdefault((r["entity_canon"], r["attribute_canon"], r["document_id"]), set()).add(upper(r))
    kept = []
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r["fact_id"]), 2):
        if any(a[k] != b[k] for k in KEYS) or a["document_id"] == b["document_id"]:
            continue
        pa, pb = upper(a), upper(b)
        key = lambda r: (r["entity_canon"], r["attribute_canon"], r["document_id"])
        if pa and pb and pa != pb and (pa in stated.get(key(b), ()) or pb in stated.get(key(a), ())):
            continue
        kept.append((a["fact_id"], b["fact_id"]))
    return sorted(kept)


def test_tieout_pairs_against_brute_force(make_facts):
    for seed in (1, 2):
        facts = random_facts(make_facts, 60, seed)
        for block_rows in (4, 4096):
            assert ids(tieouts.cross_document_pairs(facts, block_rows)) == brute_tieouts(facts.collect())


def test_tieout_findings(make_facts):
    def findings(a, b):
        return tieouts.cross_document_findings(make_facts({"document_id": "p", **a}, {"document_id": "q", **b})).collect()

    found = findings({"norm_value": 8142.0}, {"norm_value": 7860.0})
    assert [f["category"] for f in found] == ["contradiction"] and found[0]["document_ids"] == ["p", "q"]
    assert findings({"norm_value": 8142.0}, {"norm_value": 8142.0}) == []
    assert findings({"norm_value": 100.0}, {"norm_value": 40.0})[0]["severity"] == "critical"
    other = findings({"norm_value": 1.0, "period": "FY2023"}, {"norm_value": 1.0, "period": "FY2024"})
    assert (other[0]["category"], other[0]["severity"]) == ("contextual_variance", "info")


def test_internal_conflicts(make_facts):
    conflict = tieouts.intra_document_findings(make_facts({"norm_value": 100.0}, {"norm_value": 120.0})).collect()
    assert len(conflict) == 1 and conflict[0]["severity"] == "high"
    assert tieouts.intra_document_findings(make_facts({"norm_value": 100.0}, {"norm_value": 100.5})).count() == 0
    spread = make_facts({"norm_value": 100.0}, {"norm_value": 120.0}, {"norm_value": 100.0, "document_id": "d2"})
    assert tieouts.intra_document_findings(spread).count() == 0
    assert tieouts.intra_document_findings(spread, every_group=True).count() == 1


def test_facts_of_small_groups_meet_by_their_keys_alone(spark, make_facts):
    facts = make_facts(*[{"entity_canon": f"e{i % 3}", "document_id": f"d{i}"} for i in range(30)])
    assert "Generate" not in pairs.pair_up(facts, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert pairs.pair_up(facts, KEYS).count() == pairs.pair_up(facts, KEYS, block_rows=3).count() == 3 * 45
