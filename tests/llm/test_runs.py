import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from factweave.llm import decontaminate, merkle, periodic, queries


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)  # the least period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_with_runs():
    rnd, out = random.Random(5), ["", " \n", "a", "a " * 11, "a " * 12, "ab ab\tab " * 4, ("x " * 40 + "y ") * 3, "a b " * 300 + "c " + "a b " * 300]
    for k in range(60):
        base = [f"w{rnd.randrange(2 + k)}" for _ in range(rnd.randrange(1, 40))]
        text = [rnd.choice("abc") for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(1, 4)):
            text += (base * 12)[: rnd.randrange(len(base), 6 * len(base) + 1)] + [rnd.choice("abcw") for _ in range(rnd.randrange(5))]
        out.append(" ".join(text))
    return out


def test_runs_equal_brute_force():
    texts = texts_with_runs()
    sizes, runs, left = periodic.collapse(texts)
    for text, n, own, rest in zip(texts, sizes, runs, left):
        words = text.split()
        want = brute_runs(words)
        assert (n, own, rest.decode()) == (len(words), want, collapsed(words, want))
    assert periodic.collapse([]) == ([], [], []) and sum(map(len, runs)) > 60
    copy = "one two three four five six seven eight nine ten eleven twelve thirteen"
    assert periodic.collapse([copy] * 4)[1] == [[]] * 4  # neighbouring documents are no run


def test_runs_of_a_small_alphabet_and_of_long_texts():
    rnd = random.Random(6)
    for n in (11, 12, 13, 40, 200, 500):
        words = [rnd.choice("ab") for _ in range(n)]
        assert periodic.collapse([" ".join(words)])[1][0] == brute_runs(words)
    (runs,) = periodic.collapse(["a " * 200_000])[1]
    assert runs == [(0, 200_000, 1)]
    part = [f"w{rnd.randrange(5000)}" for _ in range(70_000)]
    (runs,) = periodic.collapse([" ".join(["start", *part, *part, *part[:7], "end"])])[1]
    assert (1, 140_007, 70_000) in runs


def report_of(doc_id, text):
    words = (text or "").split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len((text or "").split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *own, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))


def test_query_of_runs(spark, make_docs, prose, tmp_path):
    rows = [(i, prose(i, 10 + 7 * i, 30)) for i in range(150)] + [(None, "a " * 20), (7, None), (7, ""), (2**62, "é " * 15), (7, "b c " * 9), (7, "b c " * 9)]
    make_docs(rows, ["words", "n", "carried", "runs"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(report_of(i, t)) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 10
    make_docs([]).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_hits(text, items, width=10):
    words, hit, found = WORD.findall(lowered(text)), set(), set()
    for item, own in items:
        own = WORD.findall(lowered(own))
        grams = {tuple(own[k : k + width]) for k in range(max(len(own) - width, 0) + 1)} if own else set()
        for g in grams:
            for k in range(len(words) - len(g) + 1):
                if tuple(words[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= {str(item)} - {"None"}
    return len(words), hit, sorted(found)


def contaminated_rows(prose):
    items = [(i, prose(900 + i, 8 + 2 * i, 50)) for i in range(20)] + [(20, None), (21, "!?"), (22, "Éa 9b"), (None, "only here"), (3, "second text of THREE"), (23, items_tail(prose))]
    rows = [(i, prose(i, 120, 50)) for i in range(30)]
    for i, (_, text) in enumerate(items):
        rows.append((100 + i, f"{prose(i, 9, 50)}; {(text or '').upper().replace(' ', '--')} … {prose(i, 9, 50)}"))
    rows += [(200, None), (201, ""), (202, "éa 9B"), (203, "Éa 9B!" * 3), (None, items[5][1]), (204, items[7][1]), (204, items[7][1]), (205, "x " * 100_000 + items[9][1])]
    return rows, items


def items_tail(prose):
    return " ".join(prose(915, 38, 50).split()[-12:])  # windows shared with item 15


@pytest.mark.parametrize("block", [50_000, 40])
def test_hits_equal_brute_force_and_offsets(spark, make_docs, prose, block):
    rows, items = contaminated_rows(prose)
    docs = make_docs(rows, ["spans", "items", "carried"])
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id bigint, text string"), F.col("text"), F.struct("doc_id", "text"), block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, found = brute_hits(r.carried.text, items)
        text = r.carried.text or ""
        assert (r.n_words, r["items"]) == (n, found)
        words = [m.span() for m in WORD.finditer(lowered(text))]
        assert {k for s in r.spans for k in range(s.first, s.last + 1)} == hit
        for s in r.spans:
            assert (s.start, s.end) == (words[s.first][0], words[s.last][1])
            assert s.first - 1 not in hit and s.last + 1 not in hit


def test_query_of_decontamination(spark, make_docs, prose, tmp_path):
    rows, items = contaminated_rows(prose)
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for doc_id, text in rows:
        n, hit, found = brute_hits(text, items)
        want.append((doc_id, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in queries.op12_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and 20 < sum(r[5] for r in got) < len(rows) - 20


def test_decontaminated_documents_keep_their_columns(spark, make_docs, prose):
    rows, items = contaminated_rows(prose)
    docs, table = make_docs(rows, ["n_words", "spans"]), spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontaminate.decontaminated(docs, table)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for i, t in rows if not brute_hits(t, items)[1])
    assert decontaminate.decontaminated(docs, table.limit(0)).count() == len(rows)
    assert decontaminate.decontaminated(docs.limit(0), table).count() == 0
    answers = spark.createDataFrame([(1, "not there at all", "w1 w2")], "item_id bigint, question string, answer string")
    few = decontaminate.scan(make_docs([(1, "say W1, w2"), (2, "w2 w1")]), answers, F.col("text"), F.struct("doc_id"), fields=("question", "answer"))
    assert {r.carried.doc_id: r["items"] for r in few.collect()} == {1: ["1"], 2: []}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, None if n is None else n + more, text)))


def fold(digests):
    """Root of a list and for each entry its (left, right) siblings."""
    nodes, at, ways = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            ways[k].append(("", nodes[i + 1] if i + 1 < len(nodes) else "") if i % 2 == 0 else (nodes[i - 1], ""))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], ways


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, *fold([leaf_of(r) for r in own]))
    root, above = fold([trees[x][1] for x in langs])
    out = []
    for lang, way in zip(langs, above):
        own, subroot, ways = trees[lang]
        for row, inner in zip(own, ways):
            changed = zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 7 == 0
            now = leaf_of(row, 1 if changed else 0)
            for a, b in inner + way:
                now = sha(a + now + b)
            out.append((row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in inner + way)), now, now == root))
    return out


def manifest_rows(n):
    rows = [(i, f"text {i} é", ("en" if i % 3 else f"l{i % 5}") if i % 11 else None, f"s{i % 4}" if i % 6 else None, i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "x", "en", "s", 1), (4, "again", "en", "s", 1), (4, "again", "en", "s", 1), (5, "", "only", "", 0), (2**62, "y" * 100_000, "en", "s", 2**62)]


@pytest.mark.parametrize("levels", [12, 3])
def test_manifest_equals_brute_force(spark, levels):
    rows = manifest_rows(150)
    docs = spark.createDataFrame([(a, t, g, s, c) for a, t, g, s, c in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    docs = docs.selectExpr("*", "'x' as key", "1 as place", "2 as leaf", "3 as block")
    one_more = F.when(queries.crc_of_id() % 7 == 0, merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]))
    got = [tuple(r) for r in merkle.manifest(docs, one_more, block_levels=levels).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_manifest(rows)))
    assert not all(r[6] for r in got)
    assert merkle.manifest(docs.limit(0)).count() == 0
    untouched = merkle.manifest(docs.filter("lang = 'only'")).collect()
    assert [(r.leaf == r.subroot == r.root, r.verified, r.proof_sha256) for r in untouched] == [(True, True, sha(""))]


@pytest.mark.parametrize("fan", [2, 3])
def test_resumed_states_give_the_rebuilt_tree(fan):
    digests = [sha(str(i)).encode() for i in range(29)]
    levels = 5 if fan == 2 else 4
    tree = merkle.Tree(digests, levels, fan)
    for i in range(len(digests)):
        changed = digests[:i] + [b"new"] + digests[i + 1 :]
        assert tree.fold(i, b"new") == merkle.Tree(changed, levels, fan).nodes[-1][0]
        now = b"new"
        for left, right in tree.steps(i):
            now = hashlib.sha256(left + now + right).hexdigest().encode()
        assert now == tree.fold(i, b"new")
