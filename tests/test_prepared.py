"""What the rules read of one fact is worked out before facts meet; the outcome is the same."""

import pytest

from factweave.operators import pairs, reconcile, relations

KEYS = ["entity_canon", "attribute_canon"]
FIELDS = ("fact_id string, document_id string, entity_canon string, attribute_canon string, raw_value string, norm_value double, "
          "norm_unit string, currency string, period string, scope string, confidence double")


@pytest.fixture
def facts(spark):
    texts = ["resigned", "Active ", "profit rose", "a loss", "office 560001", "hq at 560001 west", "office 560002", "", None, "inactive, no"]
    rows = [(f"t{i}", f"d{i % 2}", "e", "note", t, None, "text", None, " fy1 ", None, 0.9) for i, t in enumerate(texts)]
    rows += [(f"n{i}", f"d{i % 3}", "e", "note" if i == 0 else "sum", str(v), v, u, c, p, s, k) for i, (v, u, c, p, s, k) in enumerate([
        (1.0, "currency", "usd", "FY1", None, 0.9), (1.005, "currency", "USD ", "fy1", " A", 0.0), (80.0, "currency", "INR", "FY2", "a", 0.4),
        (0.5, "count", None, None, "b", None), (50.0, "pct", None, "", "B", 0.9), (7.0, "kg", "XXX", "FY1", None, 0.8)])]
    return spark.createDataFrame(rows, FIELDS)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("explain", [True, False])
def test_prepared_facts_and_kinds_give_the_same_outcome(facts, explain):
    plain = rows_of(reconcile.apply_rules(pairs.pair_up(facts, KEYS), explain=explain))
    met = pairs.pair_up(reconcile.prepared(facts), KEYS)
    assert rows_of(reconcile.apply_rules(met, explain=explain)) == plain and len(plain) > 60
    assert rows_of(reconcile.apply_rules_by_kind(met, explain=explain)) == plain


def test_carried_columns_replace_the_lookup(spark, facts):
    documents = spark.createDataFrame([(f"d{i}", f"d{i}.pdf") for i in range(3)], "document_id string, filename string")
    ruled = reconcile.apply_rules(pairs.pair_up(facts, KEYS), explain=False)
    bare = reconcile.as_relations(ruled)
    carried = reconcile.as_relations(ruled, [*KEYS, *[f"{s}_{c}" for s in "ab" for c in relations.CARRIED]])
    assert rows_of(relations.counterparts(carried, facts, documents)) == rows_of(relations.counterparts(bare, facts, documents))
    for wanted in [{}, {"relation": "contextual_variance", "document_id": "d1"}]:
        found = relations.expand_relations(carried, facts, documents, **wanted)
        assert rows_of(found) == rows_of(relations.expand_relations(bare, facts, documents, **wanted)) and found.count()
