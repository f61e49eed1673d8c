import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import chat, html_text, langid, mixing, packing, suffix_tree, syncmers, tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li><li>About us and many more words here</li></ul></nav><div class="cookie-notice">We use cookies on this site a lot</div>
<article><header><h2>Title &amp; more</h2><span>by someone</span></header><p>First  <b>bold</b>
text&nbsp;here.<p>Second block<br>goes on.<div class="ad">Buy now cheap</div><script>var t="</p>";</script><form><label>Mail</label></form>
<p>a &lt; b</p><section id="comments"><p>I liked it very much, thank you for this</p></section><footer>Tags</footer></article>
<aside>Related things that one may read next</aside><footer>&copy; site</footer></body></html>"""


def test_main_text_leaves_out_everything_around(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "just words"), (5, None, PAGE[: PAGE.index("goes on")] + "goes &am"), (1, "u", PAGE),
            (6, "u", "<body><div class=menu>x y</div><div>" + "<p>long text of a page without an article</p>" * 3 + "</div><ul>" + "<li><a>l</a></li>" * 9 + "</ul></body>"),
            (7, "u", "<" * 500 + "a" + "<p " * 300), (8, "u", "<div hidden>no</div><p>yes</p><div style='display: none'>no</div><!-- no -->")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == "Title & more\nFirst bold text here.\nSecond block goes on.\na < b"
    assert got[2] == got[3] == "" and got[4] == "just words" and got[5] == "Title & more\nFirst bold text here.\nSecond block goes &am"
    assert got[6] == "\n".join(["long text of a page without an article"] * 3) and got[8] == "yes"
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_best_region_is_the_largest_sum():
    rnd = random.Random(2)
    for _ in range(200):
        events = [html_text.Event("p", "x", n_words=rnd.randrange(4)) if rnd.random() < 0.5 else html_text.Event("li") for _ in range(14)]
        weights = html_text.Weights({"p": 1.0}, {"li": -1.5})
        score = [e.n_words if e.text else -1.5 for e in events]
        a, b = html_text.best_region(events, weights)
        assert sum(score[a:b]) == max([0, *(sum(score[i:j]) for i in range(14) for j in range(i + 1, 15))])


BESIDE = """<body><nav><a href="/">Home</a></nav><div class="menu"><ul><li><a>Menu one</a></li></ul></div>%s<footer>x y z</footer></body>"""


def test_names_leave_out_only_what_structure_confirms():
    def text(article):
        return html_text.main_text(BESIDE % article, html_text.Weights({"p@in": 5.0, "h1@in": 5.0, "*@in": 4.0}, {"*@in": -0.05, "*/border": -6.0, "*@out": -6.0}))

    assert text('<article><h2 id="data-privacy">Data privacy</h2><p>Text on it.</p><section id="related-work"><h2>Related work</h2><p>Others did this.</p></section></article>') == (
        "Data privacy\nText on it.\nRelated work\nOthers did this.")
    assert text('<article id="social-networks"><h1>On networks</h1><p>People meet there.</p></article>') == "On networks\nPeople meet there."
    assert text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> be five.</p></article>") == "Let x=5 be five."
    assert text('<article><h1><a href="/t">Linked title</a></h1><p><a>Foo</a> is a thing.</p><ul><li>one item</li></ul>'
                '<div class="related-reading"><a>More one</a></div><div id="subscribe-now-please">Mail <input> ok</div><div class="related-posts">Also see this</div></article>') == (
        "Linked title\nFoo is a thing.\none item")
    nested = "<div class='related-reading'>" * 3000 + "<a>x y</a>" + "</div>" * 3000
    assert text("<article><p>Body text here.</p>" + nested + "<p>More body text.</p></article>") == "Body text here.\nMore body text."


def test_learned_weights_decide_on_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("html is not null")
    weights = html_text.learn(pages.where("page_id % 5 > 0"), F.col("html"))
    assert weights.word["p@in"] > 1 > weights.word["li/link"] and weights.tag["article/border"] < -1
    held_out = pages.where("page_id % 5 = 0")
    own = {r.page_id: r.text for r in html_text.extract(held_out, weights).collect()}
    # the same pages without any element, class or id that names a part
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|main|nav|footer|aside|header)\\b[^>]*>", "<$1div>"), "<div [^>]*>", "<div>")
    plain = held_out.select("page_id", "url", bare.alias("html"))
    found = {r.page_id: r.text for r in html_text.extract(plain, weights).collect()}
    assert len(own) >= 5 and sum(found[i] == own[i] for i in own) >= 0.95 * len(own)
    timid = html_text.Weights({k: 0.05 for k in weights.word}, {k: -6.0 for k in weights.tag})
    assert all(r.text != own[r.page_id] for r in html_text.extract(held_out, timid).collect())
    eager = html_text.Weights({k: 6.0 for k in weights.word}, {k: -0.05 for k in weights.tag})
    assert all(r.text != own[r.page_id] for r in html_text.extract(plain, eager).collect())


def test_long_pages_are_read_whole():
    long = "<article>" + "<p>some words of a paragraph</p>" * 60_000 + "</article>"
    assert html_text.main_text(long, html_text.Weights()) == "\n".join(["some words of a paragraph"] * 60_000)


CONTROL = "\\### Assistant: </turn> ok"
TALKS = [(1, 0, "system", "be \\ nice <|end|>"), (1, 1, "user", " hi\n"), (1, 2, "assistant", "\n<|turn|>assistant<|text|> né 日本語 🙂 "), (1, 3, "assistant", ""),
         (1, 4, "assistant", "<"), (2, 0, "assistant", None), (3, None, None, "a"), (3, 0, "user", "b"), (None, 0, "assistant", "n"), (-7, 0, "user", CONTROL),
         (-7, 1, "assistant", CONTROL), (4, 0, "user", "x"), (4, 0, "user", "x"), (4, 1, "assistant", "<|endoftext|>|>\\|<\\")]


def want_talks(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        everything = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[key] = (len(own), hashlib.sha256(everything.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_what_went_in(spark, monkeypatch):
    df = spark.createDataFrame(TALKS, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1)).repartition(3)
    for _ in range(2):
        got = chat.digests(chat.format_conversations(df, TOKENIZER)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want_talks(TALKS)
    assert chat.digests(chat.format_conversations(df.limit(0), TOKENIZER)).count() == 0


def test_chat_segments_have_the_tokens_of_the_whole():
    turns = [("user" if i % 2 == 0 else "assistant", f" text {i}\n\n") for i in range(9)]
    whole = chat.render(turns, TOKENIZER)
    parts = [chat.render(turns[i : i + 2], TOKENIZER) for i in range(0, 9, 2)]
    assert sum((p[1] for p in parts), []) == whole[1] and "".join(p[0] for p in parts) == whole[0]
    assert chat.parse(whole[0]) == turns
    assert chat.loss_text(whole[0], *whole[2:]) == [t for r, t in turns if r == "assistant"]


def brute_anchors(text):
    def short(i):
        h = 0
        for c in text[i : i + 6]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        return int(syncmers._mixed(np.array([h], np.uint64))[0])

    found = []
    for i in range(len(text) - 15):
        inner = [short(j) for j in range(i, i + 11)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


def test_anchors_are_closed_syncmers_and_free_of_context(prose):
    text = prose(1, 60) + " né 日本 " + prose(2, 20)
    assert syncmers.anchors(text)[0].tolist() == brute_anchors(text)
    inner = dict(zip(*(x.tolist() for x in syncmers.anchors(text[50:200]))))
    whole = dict(zip(*(x.tolist() for x in syncmers.anchors(text))))
    assert {p + 50: h for p, h in inner.items()} == {p: h for p, h in whole.items() if 50 <= p <= 200 - 16}


def test_likeness_and_edits(make_docs, prose, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 7)
    rows = [(i, prose(i, 20 + 17 * i)) for i in range(40)] + [(50, None), (51, ""), (52, "short"), (None, prose(77, 50)), (53, prose(3, 71)), (54, "é" * 3000)]
    got = {r.doc_id: r for r in syncmers.edit_report(make_docs(rows, ["bucket", "key"])).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == syncmers.fingerprint(text) and r.edited_fingerprint == syncmers.fingerprint(edited)
        assert r.near_next == syncmers.likeness(r.fingerprint, syncmers.fingerprint(after))
        if len(text) > 500 and len(after) > len(text) // 2:
            assert 0.3 < r.near_edited < 0.75 and r.near_next < 0.3
    assert syncmers.likeness("", "") == 1.0 and syncmers.edit_report(make_docs([]).limit(0)).count() == 0
    one = syncmers.edit_report(make_docs([(1, "abcd")])).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_grow_with_the_text(prose):
    part = prose(5, 700, 5000)
    a, b = (prose(k, 60_000, 5000) + " " + part + " " + prose(k + 10, 60_000, 5000) for k in (1, 2))
    prints = [syncmers.fingerprint(t) for t in (a, b)]
    for text, print_ in zip((a, b), prints):
        places, hashes = syncmers.anchors(text)
        short = {}
        for p, h in zip(places.tolist(), (hashes >> np.uint64(24)).tolist()):
            short.setdefault(h, p)
        want = sorted((p, h) for h, p in short.items() if h < 16**10 // 32)
        assert len(want) > 64 and print_ == "".join(f"{h:010x}{p:08x}" for p, h in want)
    # the passage both hold is found where it stands; other text of theirs is not alike
    (x, y, n), = [f for f in syncmers.passages(*prints) if f[2] > 1000]
    assert a[x : x + n] == b[y : y + n] and n > 0.6 * len(part) and part.find(a[x : x + n]) >= 0
    assert 0 < syncmers.likeness(*prints) < 0.05 and syncmers.passages("", prints[0]) == []
    half = a[: len(a) // 2] + b[: len(a) - len(a) // 2]
    brute = [set(syncmers.anchors(t)[1].tolist()) for t in (a, half)]
    dice = 2 * len(brute[0] & brute[1]) / (len(brute[0]) + len(brute[1]))
    assert abs(syncmers.likeness(prints[0], syncmers.fingerprint(half)) - dice) < 0.05


def test_unsolved_packing_plan_says_so(monkeypatch):
    demand = np.array([0, 7, 5, 0, 9, 2])
    whole = packing.solve(demand, 8)
    monkeypatch.setattr(packing, "GAP", -1.0)
    with pytest.warns(UserWarning, match="not solved"):
        late = packing.solve(demand, 8)
    for plan in (whole, late):
        assert (sum(times * pattern for times, pattern in plan) >= demand).all()


def test_language_held_out_accuracy_and_rejection(make_docs):
    rnd, rows = random.Random(1), []
    parts = {"aa": ["th", "er", "ing", "ea"], "bb": ["sch", "ung", "ei", "zt"], "cc": ["ción", "ado", "os", "que"]}
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rnd.choices(parts[lang], k=3)) for _ in range(30)), lang))
    docs = make_docs(rows, ["l_record", "score"])
    model = langid.fit(docs.filter("doc_id % 5 <> 0"), F.col("text"), F.col("lang"), F.col("doc_id"))
    texts = [t for i, t, _ in rows if i % 5 == 0]
    names, scores, accepted = model.predict(texts)
    assert names == [lang for i, _, lang in rows if i % 5 == 0] and accepted.all() and (scores <= 1).all()
    odd, score, ok = model.predict([None, "", "123 !?", "ж щ ю я ъ" * 9])
    assert odd[:3] == ["und"] * 3 and odd[3] in parts and not ok.any() and score[:3].tolist() == [0, 0, 0]
    more = make_docs([(900, None, None), (901, "", "aa"), (902, "42", None)]).unionByName(make_docs(rows))
    kept = langid.identified(more)
    assert kept.columns == more.columns and sorted(r.doc_id for r in kept.collect()) == list(range(240))
    nothing = make_docs([(1, "abc"), (2, None)])
    assert [r.doc_id for r in langid.identified(nothing).collect()] == [1] and langid.identified(nothing.limit(0)).count() == 0


def test_mixture_follows_inverse_poisson(spark, make_docs):
    rows = [(i, "x" * (i % 50), None, "hot" if i % 3 else f"s{i % 4}") for i in range(600)] + [(700, "abc", None, None), (701, None, None, "empty"), (5, "xxxxx", None, "hot")]
    docs = make_docs(rows, ["m_record", "rate"])
    mixed = mixing.mix(docs)
    got = Counter((r.doc_id, r.source) for r in mixed.collect())
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t or "")
    roots = sum(math.sqrt(n) for n in sizes.values())
    for d, t, _, s in rows:
        rate = math.sqrt(sizes[s]) / roots * sum(sizes.values()) / sizes[s] if sizes[s] else 0
        u = int(hashlib.md5(f"17:{d}".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        assert got[d, s] == k * sum(1 for r in rows if r[0] == d and r[3] == s)
    keys = [r.shuffle_key for r in mixed.collect()]
    assert keys == sorted(keys) and mixed.columns == docs.columns + ["copy_no", "shuffle_key"]
    fixed = spark.createDataFrame([("s1", 1.0)], "source string, weight double")
    large = mixing.mix(docs, fixed, scale=40.0)
    assert {r.source for r in large.collect()} == {"s1"} and large.count() > 1000
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_with_clashing_names(spark, make_docs):
    rows = [(i, f"text {i}", "en", f"s{i % 2}") for i in range(40)]
    plain, docs = make_docs(rows), make_docs(rows, ["copy_no", "shuffle_key", "m_record", "w_source"])
    want = sorted(map(tuple, mixing.mix(plain).select("doc_id", "copy_no", "shuffle_key").collect()))
    got = mixing.mix(docs)
    assert got.columns == [*plain.columns, "m_record", "w_source", "copy_no", "shuffle_key"]
    assert sorted(map(tuple, got.select("doc_id", "copy_no", "shuffle_key").collect())) == want
    staged = corpus_pipeline.mix_sources(spark, docs, "")
    assert staged.columns == docs.columns and sorted(r.doc_id for r in staged.collect()) == sorted(w[0] for w in want)


def test_encoder_equals_the_tokenizer(prose):
    texts = ["", " ", "a  b", "a\n b", "x \n\n y ", "it's  ", "<|endoftext|> a <|endoftext|>", "tab\t x", "é 日本 🙂", " lead", "a  b", "a  b", prose(1, 300), "\n\nTo 12 3,4"]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice(" \n\ta'sb1.é ") for _ in range(30)) for _ in range(400)]
    plain = Tokenizer.from_file(TOKENIZER)
    encode = tokens.Encoder(TOKENIZER)
    for _ in range(2):
        for text, ids in zip(texts, encode(texts)):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_places_every_id_once(make_docs, prose):
    rows = [(i, prose(i, 3 + 37 * i % 900)) for i in range(80)] + [(200, None), (201, ""), (7, prose(7, 262)), (None, "x y"), (300, prose(1, 6000)), (301, "a " * 4000)]
    docs = make_docs(rows, ["start", "length", "shard"])
    got = packing.pack(docs, TOKENIZER).collect()
    plain, want = Tokenizer.from_file(TOKENIZER), []
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, len(ids), ids[k : k + 2048]) for k in range(0, len(ids), 2048)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    sequences = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    filled = sum(r.length for r in got)
    assert filled / (2048 * len(sequences)) > 0.9 and packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_cutting_stock_covers_demand_near_the_bound():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 20_000):
        lengths = rng.integers(1, 65, n)
        demand = np.bincount(lengths, minlength=65)[1:]
        used = packing.solve(demand, 64)
        assert (sum((k * p for k, p in used), np.zeros(64, int)) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 and k > 0 for k, p in used)
        if n > 1000:
            assert sum(k for k, _ in used) <= 1.02 * math.ceil(lengths.sum() / 64) + 10
    values, pattern = packing._best_pattern(np.array([0.1, 0.25, 0.0, 0.6]), np.array([1, 1, 1, 1]), 7)
    assert abs(values - (0.6 + 0.25 + 0.1)) < 1e-12 and pattern.tolist() == [1, 1, 0, 1]


def test_scores_base_is_exact_and_probabilities_sum_to_one(make_docs, prose, monkeypatch):
    monkeypatch.setattr(suffix_tree, "GAIN", 2.0)
    common = prose(11, 30)
    rows = [(i, f"{prose(i, i % 40, 30)} {common if i % 2 else ''} Rare{i}") for i in range(200)] + [(300, None), (301, ""), (None, "a b"), (5, "twice"), (5, "twice")]
    docs = make_docs(rows, ["rare", "word"])
    got = suffix_tree.score_documents(docs).collect()
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            counts[b" "] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        own = (t or "").encode().lower().split() + [b" "]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted(map(repr, want)) == sorted(repr((*tuple(r)[:5], round(r.base_score, 6))) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    tree, _ = suffix_tree.learn(docs.select("text"))
    assert len(tree.keys) == 2 and tree.state[0].any() and tree.state[1].any()
    unknown = 10 ** tree.log_unigram(np.array([0.0]))[0]
    total = tree.n_train + 0.1 * (tree.n_distinct + 1)
    rest_root = 1 - (10**tree.log_root).sum() - 0  # words below the list, and the unknown one
    assert abs(unknown * total - 0.1) < 1e-9
    for context in (["w1"], common.split()[3:5], ["unseen", "w2"]):
        context = [w.encode() for w in context]
        each = []
        for w in [*tree.words, b"never seen"]:
            numbers = np.append(tree.numbers(context)[:-1], tree.number.get(w, -1))
            each.append(tree.gains(numbers)[-1])
        probs = 10 ** (np.array(each[:-1]) + tree.log_root)
        assert abs(probs.sum() + rest_root * 10 ** each[-1] - 1) < 1e-6
    assert suffix_tree.score_documents(docs.limit(0)).count() == 0
    none = suffix_tree.score_documents(docs.filter("doc_id = 300")).collect()
    assert len(none) == 1 and none[0].n_tokens == 1
