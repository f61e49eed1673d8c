import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from factweave.functions.similarity import _sorted_ratio
from factweave.operators import entities, retrieval, semantic


def vectors(spark, n=90, d=6, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, d))
    m = centres[rnd.integers(0, 5, n)] + 0.4 * rnd.normal(size=(n, d))
    m[3] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, None)]
    return m, spark.createDataFrame(rows, "id bigint, embedding array<double>")


def cosines(m):
    with np.errstate(invalid="ignore"):
        u = m / np.linalg.norm(m, axis=1)[:, None]
    return u @ u.T


def test_similar_pairs_against_brute_force(spark):
    m, df = vectors(spark)
    s = cosines(m)
    for threshold, pivots, block in [(0.86, 7, 10), (0.4, 4, 1000), (0.95, 16, 5)]:
        expected = sorted((i, j) for i, j in itertools.combinations(range(len(m)), 2) if s[i, j] > threshold)
        got = sorted((r["a_id"], r["b_id"]) for r in semantic.similar_pairs(df, threshold, "id", pivots=pivots, block=block).collect())
        assert got == expected


def test_similar_across_against_brute_force(spark):
    m, df = vectors(spark)
    s = cosines(m)
    left, right = df.filter("id % 3 > 0"), df.filter("id % 3 = 0").select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), "embedding")
    expected = sorted((i, f"n{j}") for i in range(len(m)) for j in range(len(m)) if i % 3 and j % 3 == 0 and s[i, j] > 0.8)
    got = semantic.similar_across(left, right, 0.8, "id", "name", pivots=5, block=7)
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == expected


def test_nearest_names_prefer_metrics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id int, embedding array<double>")
    metrics = spark.createDataFrame([("m1", [1.0, 0.3]), ("m2", [1.0, 0.3])], "name string, embedding array<double>")
    legacy = spark.createDataFrame([("l1", [1.0, 0.0]), ("l2", [0.1, 1.0])], "name string, embedding array<double>")
    rows = {r["id"]: r["name"] for r in semantic.nearest_names(v, metrics, legacy, 0.9, "id").collect()}
    assert rows == {1: "m1", 2: "l2", 3: None}


def test_vector_search(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "2024-01-01"), ("b", [0.0, 1.0], "2024-01-03"), ("c", [0.0, 0.0], "2024-01-02")],
                               "fact_id string, embedding array<double>, created_at string")
    near = retrieval.search_facts(df, [1.0, 0.1]).collect()
    assert [r["fact_id"] for r in near] == ["a", "b"]
    recent = retrieval.search_facts(df, [0.0, 1e-9]).collect()
    assert [r["fact_id"] for r in recent] == ["b", "c", "a"] and recent[0]["similarity"] == 1.0
    top = retrieval.vector_top_k(df, {"x": [1.0, 0.0], "y": [0.0, 1.0]}, 1).collect()
    assert {(r["query"], r["fact_id"]) for r in top} == {("x", "a"), ("y", "b")}


NAMES = ["acme industries", "industries acme", "acme industriess", "acme industris", "zenith capital", "zenith capitol", "zenith capital ag",
         "blue river foods", "blue river food", "blue rivers foods", "tata motors", "tata motor", "x", "xy", "a b", "b a", "kappa", "kapppa"]


def noisy_names():
    rnd = random.Random(11)
    out = set(NAMES)
    for _ in range(120):
        name = list(rnd.choice(NAMES))
        for _ in range(rnd.randrange(1, 3)):
            i = rnd.randrange(len(name) + 1)
            if rnd.random() < 0.5 and len(name) > 1:
                name.pop(min(i, len(name) - 1))
            else:
                name.insert(i, rnd.choice("abcxyz"))
        text = " ".join("".join(name).split())
        if text:
            out.add(text)
    return sorted(out)


def test_similar_names_against_brute_force(spark):
    names = noisy_names()
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for ratio in (92.0, 85.0):
        expected = {(a, b) for a in names for b in names if a != b and _sorted_ratio(a, b) > ratio}
        got = {(r["left_name"], r["right_name"]) for r in entities.similar_names(df, df, ratio).collect()}
        assert got == expected
        own = {(r["left_name"], r["right_name"]) for r in entities.similar_names(df, None, ratio).collect()}
        assert own == {(a, b) for a, b in expected if a < b}


def test_a_common_word_makes_no_candidates(spark):
    rnd, counts = random.Random(2), {}
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(20_000)]
    for n in (500, 5000, 20_000):
        names = [f"maker {w}" for w in words[: n - n // 50]] + [f"maker {w[:4]}x{w[4:]}" for w in words[: n // 50]]
        df = spark.createDataFrame([(x,) for x in names], "name string")
        counts[n] = entities.name_candidates(df).count()
        if n == 500:
            want = {(a, b) for a in names for b in names if a < b and _sorted_ratio(a, b) > 92.0}
            assert {(r["left_name"], r["right_name"]) for r in entities.similar_names(df).collect()} == want and len(want) == 10
    assert all(counts[n] < 2 * n for n in counts), counts  # of 200 million pairs


def one_by_one(names):
    leaders, expected = [], {}
    for name in names:
        scored = [(-_sorted_ratio(name, c), c) for c in leaders if _sorted_ratio(name, c) > 92.0]
        expected[name] = min(scored)[1] if scored else name
        if not scored:
            leaders.append(name)
    return expected


def test_canonical_names_against_one_by_one(spark):
    names = noisy_names()
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seen int")
    assert {r["name"]: r["canonical"] for r in entities.canonical_names(df, order="seen").collect()} == one_by_one(names)
    mixed = [r["name"] for r in df.orderBy(F.xxhash64("name"), "name").collect()]
    assert {r["name"]: r["canonical"] for r in entities.canonical_names(df).collect()} == one_by_one(mixed)


def test_known_canonicals_fall_back_to_aliases(spark):
    aliases = spark.createDataFrame([("a", "Acme"), ("b", "Acme")], "alias string, canonical string")
    none = spark.createDataFrame([], "canonical_name string")
    some = spark.createDataFrame([("Zen",)], "canonical_name string")
    assert [r["name"] for r in entities.known_canonicals(none, aliases).collect()] == ["Acme"]
    assert [r["name"] for r in entities.known_canonicals(some, aliases).collect()] == ["Zen"]


def test_citations_and_artifacts(spark):
    text = 'Revenue rose [2], then [F1] and [2] and [9].\n```json:block {"type": "chart", "title": "T"} ```\n```json {"no": 1}``` ```json [1] ``` ```json {x ```'
    answers = spark.createDataFrame([("a", text)], "id string, answer string")
    context = spark.createDataFrame([("a", 1, "f1"), ("a", 2, "f2"), ("a", 3, "f3")], "id string, number bigint, fact_id string")
    cited = retrieval.citations(answers, context, "id", "answer").orderBy("position").collect()
    assert [r["fact_id"] for r in cited] == ["f2", "f1"]
    found = retrieval.artifacts(answers, "id", "answer").collect()
    assert [(r["type"], r["title"]) for r in found] == [("chart", "T")]
    cleaned = retrieval.clean_answers(answers, "id", "answer").collect()[0]["answer"]
    assert "chart" not in cleaned and '{"no": 1}' in cleaned and cleaned.startswith("Revenue rose")


def test_hybrid_takes_each_fact_once(spark):
    rows = [("a", "cash", 0.9, [1.0, 0.0]), ("b", "debt", 0.8, [0.9, 0.1]), ("c", "cash flow", 0.7, [0.0, 1.0])]
    facts = spark.createDataFrame(rows, "fact_id string, quote string, confidence double, embedding array<double>").withColumn("entity", F.lit("x"))
    got = retrieval.hybrid(facts, [("Cash", [1.0, 0.0]), ("debt", [0.0, 0.0])], per_source=2).orderBy("number").collect()
    assert [r["fact_id"] for r in got] == ["a", "b", "c"]


def test_text_filter_and_sorting(spark):
    df = spark.createDataFrame([(7, "Seven"), (10, "ten"), (2, "two7")], "n int, t string")
    assert {r["n"] for r in retrieval.text_filter(df, "7").collect()} == {7, 2}
    assert [r["n"] for r in retrieval.sort_rows(df, "n").collect()] == [2, 7, 10]
    assert [r["t"] for r in retrieval.sort_rows(df, "t", descending=True).collect()] == ["two7", "ten", "Seven"]
    assert retrieval.text_filter(df, "  ").count() == 3


def test_history_tail(spark):
    df = spark.createDataFrame([("c", i, "user", f"m{i}") for i in range(6)], "conv_id string, turn int, role string, text string")
    assert [r["line"] for r in retrieval.history_tail(df).orderBy("turn").collect()] == ["user: m2", "user: m3", "user: m4", "user: m5"]


def clustered(spark, n, centres, dims=24, spread=0.02, seed=5):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, dims))
    vectors = middle[rnd.integers(0, centres, n)] + spread * rnd.normal(size=(n, dims)) * np.linalg.norm(middle, axis=1).mean()
    return vectors, spark.createDataFrame([(f"f{i:05d}", v.tolist()) for i, v in enumerate(vectors)], "fact_id string, embedding array<double>")


def test_semantic_sweep_at_the_reference_threshold(spark):
    vectors, df = clustered(spark, 3000, 40)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = np.triu(unit @ unit.T > 0.86, 1)
    want = {(f"f{i:05d}", f"f{j:05d}") for i, j in zip(*np.nonzero(close))}
    got = [(r.a_id, r.b_id) for r in semantic.similar_pairs(df, 0.86, block=64).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50_000
    shipped = semantic.block_pairs(df, 0.86, "fact_id", "embedding", semantic.PIVOTS, 64).groupBy("cell", "kind", "i", "j").agg(
        F.sum(F.when((F.col("kind") == "nv") & ~F.col("native"), 1).otherwise(0)).alias("v"), F.count("*").alias("n")).collect()
    products = sum((r.n - r.v) * r.v if r.kind == "nv" else r.n * r.n if r.i == r.j else r.n * r.n // 4 for r in shipped)
    assert products < 3000 * 3000 / 2 / 3  # all pairs of blocks would be 4.5 million products


def test_semantic_join_across_two_tables(spark):
    vectors, df = clustered(spark, 400, 8)
    left, right = df.filter("fact_id < 'f00200'"), df.filter("fact_id >= 'f00200'").withColumnRenamed("fact_id", "name")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(f"f{i:05d}", f"f{j:05d}") for i, j in zip(*np.nonzero(unit @ unit.T > 0.86)) if i < 200 <= j}
    assert {(r.a_id, r.b_id) for r in semantic.similar_across(left, right, 0.86, "fact_id", "name", block=50).collect()} == want
