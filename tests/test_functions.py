import random
import hashlib

import pytest
from pyspark.sql import functions as F

from factweave.functions import names, numbers, text
from factweave.functions.periods import normalized_period
from factweave.functions.similarity import _common, _masks, _ratio, _sorted_ratio, best_partial_ratio
from factweave.sources.intake import page_route


def read_numbers(spark, inputs):
    rows = [(i, raw, value) for i, (raw, value) in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, raw string, value double")
    return [r["n"] for r in numbers.with_number(df, "raw", "value", "n").orderBy("i").collect()]


def test_numbers(spark):
    cases = [
        ("(1,234.50)", None, -1234.5, "count", None),
        ("(₹ 20 crore)", None, -2e8, "currency", "INR"),
        ("(₹ 1,234.50 Cr)", None, -12345000000.0, "currency", "INR"),
        ("Net loss of $45.2 million", None, -45200000.0, "currency", "USD"),
        ("25 lakh", None, 2.5e6, "count", None),
        ("1.5 billion", None, 1.5e9, "count", None),
        ("12.5%", None, 12.5, "pct", None),
        ("40 basis points", None, 40.0, "bps", None),
        ("2 crore", 2.0, 2e7, "count", None),
        ("2000 crore", 2000.0, 2000.0, "count", None),
        ("20cr", None, None, "text", None),
        ("100 (FY2023)", None, -100.0, "count", None),
        ("unchanged", None, None, "text", None),
    ]
    got = read_numbers(spark, [(raw, value) for raw, value, *_ in cases])
    for (raw, _, value, unit, currency), n in zip(cases, got):
        assert n["norm_value"] == pytest.approx(value) if value is not None else n["norm_value"] is None, raw
        assert (n["norm_unit"], n["currency"]) == (unit, currency), raw
    assert read_numbers(spark, [(None, None), ("", None)]) == [None, None]


def test_periods(values):
    cases = {
        "FY23": "FY2023", "year ended Mar 2023": "FY2023", "Q3 2023": "2023-Q3", "2023-24": "FY2024", "H1 FY24": "H1-FY2024",
        "9M ended FY24": "9M-FY2024", "Q4 FY24": "2024-Q4", "year ended March 31, 2023": "FY2023", "3Q23": "2023-Q3", "2023 Q3": "2023-Q3",
        "2H2024": "H2-FY2024", "nine months 2022": "9M-FY2022", "TTM": "TTM", "trailing twelve months 2021": "TTM-2021",
        "1999-00": "FY1900", "in 2019": "2019", " soon ": "soon", "": None, None: None,
    }
    assert values(normalized_period(F.col("x")), list(cases)) == list(cases.values())
    assert values(normalized_period(F.col("x"), F.col("y")), [(None, "reported in 2020")], "x string, y string") == ["2020"]


def test_entities(values):
    cases = {
        "Apple Inc.": "Apple", "Tata Motors Pvt Ltd": "Tata Motors", "rbi": "Reserve Bank of India", "SEBI": "Securities and Exchange Board of India",
        "Reliance Industries Limited": "Reliance Industries", "Limited": "Limited", "café noir GmbH": "Café Noir", "o_neil a1b": "O_Neil A1B",
    }
    assert values(names.clean_entity(F.col("x")), list(cases)) == list(cases.values())


def test_attributes(values):
    cases = {"Revenue from Operations": "operating revenue", "PAT (FY24)": "net income", "Adjusted EBITDA": "adjusted ebitda",
             "Net  debt!": "net debt", "": None, None: None}
    assert values(names.canonical_attribute(F.col("x")), list(cases)) == list(cases.values())


def test_compact_numbers(values):
    inputs = [0.0, 100.0, 7860.0, 123456.0, 1234567.0, 0.0001, 0.00001, -2.5, 1e-9, 83333.333333]
    assert values(numbers.compact(F.col("x")), inputs, "x double") == [f"{v:g}" for v in inputs]


def test_first_digit_and_severity(values):
    assert values(numbers.first_digit(F.col("x")), [123.45, 9876.0, 0.045, -0.045, 0.0, None], "x double") == [1, 9, 4, 4, None, None]
    deltas = [0.60, 1.0, 0.15, 0.49, 0.08, 0.02, 0.0]
    assert values(numbers.delta_severity(F.col("x")), deltas, "x double") == ["critical", "critical", "high", "high", "medium", "low", "low"]
    assert [float(v) if v is not None else None for v in values(numbers.safe_decimal(F.col("x")), ["12.5", "n/a", None])] == [12.5, None, None]


def test_content_hash(values):
    h = lambda content, page, kind: text.content_hash(F.lit(content), F.lit(page).cast("int"), F.lit(kind))
    one = values(h("Revenue was $50M", 14, "paragraph"), ["x"])[0]
    assert one == hashlib.sha256(b"Revenue was $50M|14|paragraph").hexdigest()
    assert one != values(h("Revenue was $50M", 15, "paragraph"), ["x"])[0]
    assert values(h("a", None, "table_cell"), ["x"])[0] == hashlib.sha256(b"a|None|table_cell").hexdigest()
    assert values(text.prompt_hash(F.lit("s"), F.lit("u")), ["x"])[0] == hashlib.sha256(b"s|||u").hexdigest()


def test_evidence_types(values):
    assert values(text.evidence_type(F.col("x")), ["table", "ocr_block", "heading", "odd", None]) == ["table_cell", "ocr_text", "heading", "paragraph", "paragraph"]


def test_table_hints(spark):
    df = spark.createDataFrame([(["Revenue (₹ Cr)", "FY 2024"], "x"), (["Sales in USD mn"], "Q2 2023 results"), (["Share %"], "Q1 FY2023")], "h array<string>, c string")
    got = [tuple(r["t"]) for r in df.select(text.table_hints(F.col("h"), F.col("c")).alias("t")).collect()]
    assert got == [("crore", "INR", "FY2024"), ("million", "USD", "Q22023"), ("pct", None, "FY2023")]


def test_heuristic_facts(spark):
    body = "Total revenue stood at ₹7,860 Cr for the year.\nNet profit was 12.5% of sales\ntiny: 1"
    df = spark.createDataFrame([("c1", body, "Results FY 2024")], "chunk_id string, text string, heading string")
    rows = text.heuristic_facts(df).orderBy("line_no").collect()
    assert [(r["attribute"], r["raw_value"], r["period"]) for r in rows] == [("Total revenue", "₹7,860 Cr", "FY 2024"), ("Net profit", "12.5%", "FY 2024")]


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_similarity_against_brute_force():
    words = ["acme corp", "acme corporation", "corp acme", "", "zebra", "acne crop", "a", "abcabcabc"]
    for a in words:
        for b in words:
            assert _common(_masks(a), len(a), b) == brute_common(a, b)
    assert _sorted_ratio("corp acme", "acme corp") == 100.0
    assert best_partial_ratio("revenue rose", "we saw revenue rose fast") == 100.0
    assert best_partial_ratio("revenue roze", "we saw revenue rose fast") > 85.0
    assert best_partial_ratio("qqqq", "we saw revenue rose fast") == 0.0


def brute_partial(a, b):
    short, long = sorted((a, b), key=len) if len(a) != len(b) else (a, b)
    if not short:
        return 100.0 if not long else 0.0
    return max(_ratio(short, long[max(0, end - len(short)) : end]) for end in range(1, len(long) + len(short)))


def altered(rnd, quote, share):
    out = []
    for ch in quote:
        x = rnd.random()
        if x < share:
            out += [] if x < share / 3 else [rnd.choice("abcde ")] if x < 2 * share / 3 else [ch, rnd.choice("abcde ")]
        else:
            out.append(ch)
    return "".join(out)


def test_partial_ratio_of_quotes_from_anywhere():
    rnd = random.Random(4)
    words = ["net", "revenue", "rose", "fell", "to", "12,5", "crore", "in", "margin", "of", "the", "unité"]
    seen = set()
    for k in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 90)))
        start = rnd.randrange(len(text))
        quote = altered(rnd, text[start : start + rnd.randrange(1, 90)], rnd.choice([0.0, 0.05, 0.15, 0.3, 0.6]))
        want = brute_partial(quote, text)
        assert abs(best_partial_ratio(quote, text) - want) < 1e-9
        for cutoff in (60.0, 85.0, 97.0):
            got = best_partial_ratio(quote, text, cutoff)
            assert abs(got - want) < 1e-9 if want >= cutoff else got == 0.0
        seen.add(want >= 85)
    assert seen == {True, False}


def test_quote_confidence(values):
    pairs = [("Revenue ROSE", "the revenue rose.", 0.9), ("xyzxyz", "the revenue rose.", 0.9), ("xyzxyz", "the revenue rose.", 0.3)]
    got = values(text.verified_confidence(F.col("q"), F.col("t"), F.col("c")), pairs, "q string, t string, c double")
    assert got == [0.9, 0.4, 0.3]


def test_page_route(values):
    got = values(page_route(F.col("t"), F.col("n"), F.col("bad")), [("x" * 40, 0, False), ("short", 0, False), ("", 2, False), ("  ", 0, False), ("x" * 99, 0, True)],
                 "t string, n int, bad boolean")
    assert got == ["text", "scan", "scan", "empty", "error"]
