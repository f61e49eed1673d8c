"""Groups of a few facts are counted as their pairs are made; larger ones by arithmetic, with the same counts."""

import random

import pytest

from factweave.operators import counting, pairs, reconcile, relations

KEYS = ["entity_canon", "attribute_canon"]


@pytest.fixture
def facts(make_facts):
    rnd = random.Random(11)
    return make_facts(*[{
        "entity_canon": rnd.choice(["hot", "hot", "b", "c", None]), "norm_value": rnd.choice([None, 100.0, 100.5, 99.0, 7.0, -1.0]),
        "raw_value": rnd.choice(["he resigned", "he continues", "office 560001"]), "currency": rnd.choice(["USD", "INR", "XXX", None]),
        "period": rnd.choice(["FY2020", "FY2021", None]), "confidence": rnd.choice([0.9, 0.4, 0.0]), "scope": rnd.choice([None, "a", "b"]),
    } for _ in range(120)])


@pytest.mark.parametrize("small", [0, 40, 256])
def test_small_and_large_groups_give_the_same_counts(monkeypatch, facts, small):
    listed = reconcile.apply_rules(pairs.pair_up(facts, KEYS), explain=False).groupBy(*KEYS, "relation").count().collect()
    monkeypatch.setattr(counting, "SMALL_GROUP", small)
    assert sorted(map(tuple, counting.relation_counts(facts, KEYS).collect())) == sorted(map(tuple, listed)) and len(listed) > 8


def test_small_groups_write_no_working_tables(monkeypatch, facts):
    written, old = [], counting.write_through
    monkeypatch.setattr(counting, "write_through", lambda df, name: written.append(name) or old(df, name))
    assert counting.relation_counts(facts).count() == 4 and relations.matrix_of_facts(facts).count() > 2
    assert written == []
