import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from factweave.llm import exact_index, graph, repeats, simhash


def brute_exact(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for norm, own in groups.items():
        best = min(own)
        out += [(rows[i][0], rows[best[3]][0], len(own), hashlib.sha256(norm.encode()).hexdigest()) for *_, i in own]
    return out


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " ab"), (7, "x" * 50_000), (8, "x" * 50_000), (None, "ab"),
        (9, "same"), (9, "same"), (10, "é")]


def test_exact_report_equals_brute_force(make_docs):
    got = exact_index.duplicate_report(make_docs(ROWS, ["digest", "kept", "row_no"])).collect()
    found = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_exact(ROWS)))
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_index.duplicate_report(make_docs([]).limit(0)).count() == 0


def test_exact_stage_keeps_columns_and_index_persists(spark, make_docs, tmp_path):
    docs = make_docs(ROWS, ["digest", "record"])
    kept = exact_index.without_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[3] for r in brute_exact(ROWS)})
    path = f"file://{tmp_path}/index"
    index = exact_index.DigestIndex.open(spark, path, buckets=4)
    assert exact_index.duplicate_report(make_docs([(1, "a"), (2, "b")]), index).filter("kept").count() == 2
    index.drop()
    again = exact_index.DigestIndex.open(spark, path, buckets=4)
    later = {r.doc_id: r.kept for r in exact_index.duplicate_report(make_docs([(3, "a "), (4, "c"), (5, "c")]), again).collect()}
    assert later == {3: False, 4: True, 5: False}
    plan = again.unknown(spark.createDataFrame([(bytearray(b"1"), 1, 1, 1)], exact_index.ENTRY))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    again.drop()


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_definition_and_spark_hash(spark, prose):
    for text in ["", " \n", "One", "one TWO", "É a A b", prose(1, 500)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    signed = spark.sql("select xxhash64('one two three') h").first().h
    assert xxhash.xxh64_intdigest(b"one two three", 42) == signed % 2**64


def test_every_close_pair_meets_at_an_anchor(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for f in list(fps):
        for n in (1, 2, 3):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), n)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 2}
    found = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()
    assert len(found) == len(set(found)) and {(r.u, r.v) for r in found} == want


def test_near_groups_equal_brute_force(make_docs, prose):
    base = prose(3, 400)
    rows = [(i, base.replace("w7 ", f"q{i} ", 1)) for i in range(12)] + [(100 + i, prose(50 + i, 60)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " "), (203, "one"), (204, "ONE"), (203, "one")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicate_groups(make_docs(rows, ["fp", "key"])).collect()}
    keyed = [(d, brute_fingerprint(t or "")) for d, t in rows]
    label = {k: k for k in keyed}
    for _ in keyed:
        for a in keyed:
            for b in keyed:
                if bin(a[1] ^ b[1]).count("1") <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {(d, f"{f:016x}"): label[d, f][0] for d, f in keyed}
    docs = make_docs(rows)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_roots_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in graph.roots(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}}


def brute_repeats(rows, width=13):
    words = [(2**63 if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for key, _, w in words:
        for i in range(len(w) - width + 1):
            first[tuple(w[i : i + width])] = min(key, first.get(tuple(w[i : i + width]), key))
    out = []
    for key, d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_repeats_equal_brute_force(make_docs, prose):
    passage, rows = prose(9, 40), []
    for i in range(40):
        rows.append((i, " ".join([prose(i + 100, i), passage[: 30 + 7 * i], prose(i + 200, 10), "a " * (i % 5 * 9), "b c " * (i % 3 * 20)])))
    rows += [(50, None), (51, ""), (52, "one two"), (53, prose(9, 40)), (None, prose(9, 40)), (54, "a " * 3000), (54, prose(9, 30)), (54, "a " * 40),
             (55, " ".join(passage.split()[:13])), (56, " ".join(passage.split()[:12])), (57, "É  " + passage)]
    got = repeats.without_repeats(make_docs(rows, ["key", "symbol", "places"])).collect()
    found = sorted(map(repr, (tuple(r) for r in got)))
    assert found == sorted(map(repr, brute_repeats(rows)))
    assert sum(r.n_removed for r in got) > 500
    assert repeats.without_repeats(make_docs(rows).limit(0)).count() == 0


def test_equal_windows_have_equal_representatives(prose):
    shared = prose(4, 60)
    texts = [prose(i, 20 + i) + " " + shared + " " + prose(i + 50, 33 - i) for i in range(20)]
    hashes, counts = repeats._parsed(texts)
    doc, place, symbol = repeats.representatives(hashes, counts)
    begin = place + [int(x) for x in 0 * place]
    starts = counts.cumsum() - counts
    seen = {}
    for d, p, s in zip(doc.tolist(), begin.tolist(), symbol.tolist()):
        content = tuple(hashes[starts[d] + p : starts[d] + p + 13].tolist())
        assert seen.setdefault(content, s) == s
    assert len(set(symbol.tolist())) < 0.5 * len(symbol)
