import pytest

from factweave.operators.pairs import pair_up
from factweave.operators.reconcile import apply_rules


@pytest.fixture
def judge(make_facts):
    """Outcomes of several pairs of facts; each pair gets a group of its own."""

    def run(*pairs):
        rows = []
        for i, (a, b) in enumerate(pairs):
            rows += [{"fact_id": f"{i:03d}a", "chunk_id": str(i), **a}, {"fact_id": f"{i:03d}b", "chunk_id": str(i), **b}]
        return apply_rules(pair_up(make_facts(*rows), ["chunk_id"])).orderBy("a_fact_id").collect()

    return run


def test_low_confidence(judge):
    cases = [(0.35, 0.95), (0.95, 0.25), (0.3, 0.4)]
    for r in judge(*[({"confidence": a, "norm_value": 1.0}, {"confidence": b, "norm_value": 1.0}) for a, b in cases]):
        assert r["relation"] == "needs_review" and r["rules"] == ["R1:low_confidence"] and "Low confidence" in r["explanation"]


def test_context(judge):
    cases = [
        ({"period": "FY2022"}, {"period": "fy2023"}, "R2:context_diff:period"),
        ({"scope": "standalone"}, {"scope": "Consolidated"}, "R2:context_diff:scope"),
        ({"entity_canon": "acme"}, {"entity_canon": "other"}, "R2:context_diff:entity"),
        ({"currency": "XYZ"}, {"currency": "USD"}, "R2:context_diff:currency"),
        ({"norm_unit": "bps"}, {"norm_unit": "pct"}, "R2:context_diff:unit"),
    ]
    rows = judge(*[({"norm_value": 5.0, **a}, {"norm_value": 5.0, **b}) for a, b, _ in cases])
    for r, (_, _, tag) in zip(rows, cases):
        assert r["relation"] == "contextual_variance" and tag in r["rules"] and "values not compared" in r["explanation"]


def test_numbers_and_conversions(judge):
    pct, part = {"norm_unit": "pct", "currency": None}, {"norm_unit": "count", "currency": None}
    close, far, fx, up, down, zero = judge(
        ({"norm_value": 1000.0}, {"norm_value": 1005.0}),
        ({"norm_value": 1000.0}, {"norm_value": 1200.0}),
        ({"norm_value": 100.0}, {"norm_value": 8333.33, "currency": "INR"}),
        ({"norm_value": 25.0, **pct}, {"norm_value": 0.25, **part}),
        ({"norm_value": 0.25, **part}, {"norm_value": 25.0, **pct}),
        ({"norm_value": 1.0, "confidence": 0.0}, {"norm_value": 1.0}),
    )
    assert close["relation"] == "corroborates" and close["rules"] == ["R4:tolerance_match"]
    assert far["relation"] == "contradicts" and "16.7%" in far["explanation"] and "(1000 vs 1200)" in far["explanation"]
    assert fx["relation"] == "corroborates" and fx["rules"] == ["R3:FX:INR->USD@0.0120", "R4:tolerance_match"]
    assert up["rules"] == ["R3:fraction_to_pct", "R4:tolerance_match"] and down["relation"] == "corroborates"
    assert zero["relation"] == "corroborates" and zero["relation_confidence"] == 0.95


def test_text(judge):
    cases = [
        ("Director resigned from office", "Director continues in office", "contradicts", "R5:verb_opposition:resigned_vs_continues"),
        ("CEO stepped down", "CEO was appointed", "contradicts", "R5:verb_opposition:stepped down_vs_appointed"),
        ("resigned and ceased", "active", "contradicts", "R5:verb_opposition:ceased_vs_active"),
        ("12 Hill Road, Mumbai 400051", "Flat 9, Sea View, Bombay 400051", "corroborates", "R5:string_match"),
        ("office in Pune", "office in Pune", "corroborates", "R5:string_match"),
        ("pune office in", "Office in Pune", "corroborates", "R5:string_match"),
        ("blue", "a different statement altogether", "needs_review", "R5:unmatched_text"),
        (None, "", "corroborates", "R5:string_match"),
    ]
    rows = judge(*[({"raw_value": a}, {"raw_value": b}) for a, b, *_ in cases])
    assert [(r["relation"], r["rules"]) for r in rows] == [(relation, [rule]) for _, _, relation, rule in cases]
