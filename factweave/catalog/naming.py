"""Queries on numbers, periods, names, text claims and quotes; inputs are composed from table values."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import names, numbers, text
from factweave.functions.numbers import with_number
from factweave.functions.periods import normalized_period
from factweave.operators import entities, pairs, reconcile
from factweave.plans import ingest
from factweave.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict = {}


def _pick(key, *choices):
    """The choice numbered key % len(choices)."""
    result = F.lit(None)
    for i, c in reversed(list(enumerate(choices))):
        result = F.when(key % len(choices) == i, c).otherwise(result)
    return result


def _says(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def normalize_numbers(spark, folder):
    o = read_table(spark, folder, "orders")
    k, q = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    raw = _pick(
        k, _says("(₹ ", q, " crore)"), _says("$", q, " million"), _says(q, "%"), _says(q, " bps"),
        _says("1,", F.lpad((k % 1000).cast("string"), 3, "0"), ".5"), _says("Net loss of €", q, " bn"), F.lit("approved by the board"),
        _says(q, " lakh"), _says("-", q, " Cr"), F.lit("20cr"),
    )
    rows = o.select(k.alias("o_orderkey"), raw.alias("raw"), F.when(k % 10 == 7, F.lit(25.0)).alias("given"))
    return with_number(rows, "raw", "given", "n").select("o_orderkey", "n.norm_value", "n.norm_unit", "n.currency")


QUERIES["normalize_numbers"] = normalize_numbers
ORACLES["normalize_numbers"] = """
WITH t AS (SELECT o_orderkey, o_orderkey % 10 AS m, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS q FROM orders)
SELECT o_orderkey,
  CASE m WHEN 0 THEN -(q * 1e7) WHEN 1 THEN q * 1e6 WHEN 2 THEN q WHEN 3 THEN q WHEN 4 THEN CAST(1000 + o_orderkey % 1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)
         WHEN 5 THEN -(q * 1e9) WHEN 7 THEN 2500000.0 WHEN 8 THEN -(q * 1e7) END AS norm_value,
  CASE m WHEN 0 THEN 'currency' WHEN 1 THEN 'currency' WHEN 2 THEN 'pct' WHEN 3 THEN 'bps' WHEN 4 THEN 'count' WHEN 5 THEN 'currency'
         WHEN 7 THEN 'count' WHEN 8 THEN 'count' ELSE 'text' END AS norm_unit,
  CASE m WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 5 THEN 'EUR' END AS currency
FROM t
"""


def normalize_periods(spark, folder):
    o = read_table(spark, folder, "orders")
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    yy, nxt = F.substring(y, 3, 2), F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0")
    stated = _pick(
        k, _says("FY", yy), _says("Q3 ", y), _says("3Q", yy), _says(y, "-Q2"), _says("H1 FY", yy), _says("2H", y), _says("9M ended FY", yy),
        _says("year ended Mar ", y), _says("year ended March 31, ", y), _says(y, "-", nxt), _says("TTM ", y), _says("as of ", y),
        F.lit("n/a"), F.lit(None).cast("string"), _says("Fiscal ", y),
    )
    rows = o.select("o_orderkey", stated.alias("stated"), F.when(k % 15 == 13, _says("in ", y)).alias("raw"))
    return rows.select("o_orderkey", normalized_period(F.col("stated"), F.col("raw")).alias("period"))


QUERIES["normalize_periods"] = normalize_periods
ORACLES["normalize_periods"] = """
WITH t AS (SELECT o_orderkey, o_orderkey % 15 AS m, CAST(year(o_orderdate) AS VARCHAR) AS y, substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) AS yy,
                  CAST(year(o_orderdate) + 1 AS VARCHAR) AS nxt FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN 'FY20' || yy WHEN 1 THEN y || '-Q3' WHEN 2 THEN '20' || yy || '-Q3' WHEN 3 THEN y || '-Q2'
   WHEN 4 THEN 'H1-FY20' || yy WHEN 5 THEN 'H2-FY' || y WHEN 6 THEN '9M-FY20' || yy WHEN 7 THEN 'FY' || y WHEN 8 THEN 'FY' || y
   WHEN 9 THEN 'FY' || substr(y, 1, 2) || substr(nxt, 3, 2) WHEN 10 THEN 'TTM-' || y WHEN 11 THEN y WHEN 12 THEN 'n/a' WHEN 13 THEN y
   ELSE 'FY' || y END AS period
FROM t
"""


def _stated_names(spark, folder):
    p = read_table(spark, folder, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    return p.select("p_partkey", _pick(
        k, _says(n, " Inc."), _says(n, " Private Limited"), F.lit("rbi"), _says("The ", n, " Holdings Co."), F.col("p_brand"),
        F.lit("Limited"), _says(n, " Pvt. Ltd."), _says(F.upper(n), ", LLC")).alias("stated"))


def clean_entities(spark, folder):
    cleaned = _stated_names(spark, folder).withColumn("cleaned", names.clean_entity(F.col("stated")))
    aliases = read_table(spark, folder, "supplier").select(
        F.concat(F.lit("brand "), F.col("s_suppkey").cast("string")).alias("alias"),
        F.concat(F.lit("Maker "), F.col("s_name")).alias("canonical"))
    return names.resolve_aliases(cleaned, aliases).select("p_partkey", "cleaned", "canonical")


QUERIES["clean_entities"] = clean_entities
ORACLES["clean_entities"] = """
WITH t AS (SELECT p_partkey, p_partkey % 8 AS m, p_brand,
             array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS n FROM part),
c AS (SELECT p_partkey, CASE m WHEN 2 THEN 'Reserve Bank of India' WHEN 3 THEN 'The ' || n WHEN 4 THEN replace(p_brand, '#', ' ')
             WHEN 5 THEN 'Limited' ELSE n END AS cleaned FROM t)
SELECT p_partkey, cleaned, coalesce('Maker ' || s.s_name, cleaned) AS canonical
FROM c LEFT JOIN supplier s ON lower(c.cleaned) = 'brand ' || s.s_suppkey
"""


def canonical_attributes(spark, folder):
    p = read_table(spark, folder, "part")
    k, n = F.col("p_partkey"), F.col("p_name")
    stated = _pick(k, F.lit("Revenue from Operations"), _says("Total Income (", n, ")"), F.lit("PAT - consolidated"), _says(n, ", net!"),
                   F.lit("Adjusted EBITDA margin"), F.lit("EBITDA/share"), F.lit("Profit  before   tax"))
    return p.select("p_partkey", stated.alias("stated")).select("p_partkey", names.canonical_attribute(F.col("stated")).alias("attribute_canon"))


QUERIES["canonical_attributes"] = canonical_attributes
ORACLES["canonical_attributes"] = """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'operating revenue' WHEN 1 THEN 'total revenue' WHEN 2 THEN 'net income' WHEN 3 THEN p_name || ' net'
   WHEN 4 THEN 'adjusted ebitda' WHEN 5 THEN 'ebitda' ELSE 'pbt' END AS attribute_canon FROM part
"""


def normalize_facts(spark, folder):
    o = read_table(spark, folder, "orders")
    k, q = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    extracted = o.select(
        k.cast("string").alias("fact_id"), _says("Customer ", F.col("o_custkey"), " Pvt. Ltd.").alias("entity"),
        _pick(k, F.lit("Total Income"), F.lit("EBITDA")).alias("attribute"),
        _pick(k, _says("$", q, " million"), _says(q), F.lit("unchanged")).alias("raw_value"),
        F.lit(None).cast("double").alias("value_number"), F.lit("GBP").alias("currency"), F.lit("count").alias("unit"),
        _says("FY ", F.year("o_orderdate")).alias("period"))
    return ingest.normalize_facts(extracted).select("fact_id", "entity_canon", "attribute_canon", "norm_value", "norm_unit", "currency", "period")


QUERIES["normalize_facts"] = normalize_facts
ORACLES["normalize_facts"] = """
WITH t AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS q FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, 'Customer ' || o_custkey AS entity_canon,
       CASE o_orderkey % 2 WHEN 0 THEN 'total revenue' ELSE 'ebitda' END AS attribute_canon,
       CASE o_orderkey % 3 WHEN 0 THEN q * 1e6 WHEN 1 THEN q END AS norm_value,
       CASE o_orderkey % 3 WHEN 0 THEN 'currency' WHEN 1 THEN 'count' ELSE 'text' END AS norm_unit,
       CASE o_orderkey % 3 WHEN 0 THEN 'USD' ELSE 'GBP' END AS currency, 'FY' || year(o_orderdate) AS period FROM t
"""


_LETTERS = ("0123456789", "ghijklmnop")


def _maker(number, salt):
    """A name of twelve letters that is unlike the others."""
    return F.translate(F.substring(F.md5(F.concat(F.lit(salt), number.cast("string"))), 1, 12), *_LETTERS)


def _normalization(spark, folder):
    supplier, e = read_table(spark, folder, "supplier"), read_table(spark, folder, "embeddings")
    n_suppliers, n_vectors = supplier.count(), e.count()
    k = F.col("p_partkey")
    s = k % n_suppliers
    stated = _pick(k, F.concat(F.lit("maker "), _maker(s, "s")), _says("BRAND ", s), F.expr("left(concat('Maker ', w), 17)"),
                   F.concat(F.lit("Newco "), _maker(k % 50, "n")))
    extracted = read_table(spark, folder, "part").withColumn("w", _maker(s, "s")).select(
        k.alias("fact_id"), F.concat(stated, F.when(k % 3 == 0, " Ltd.").otherwise("")).alias("entity"), _says("Measure ", k % n_vectors).alias("attribute"),
        F.lit("5 million").alias("raw_value"), F.lit(None).cast("double").alias("value_number"), F.lit("USD").alias("currency"), F.lit("count").alias("unit"),
        F.lit("FY 2024").alias("period"))
    makers = supplier.select(F.col("s_suppkey"), F.concat(F.lit("Maker "), F.initcap(_maker(F.col("s_suppkey"), "s"))).alias("name"))
    aliases = makers.select(F.concat(F.lit("brand "), F.col("s_suppkey").cast("string")).alias("alias"), F.col("name").alias("canonical"))
    first, last = (e.groupBy("label").agg(f("embedding", "vec_id").alias("embedding")) for f in (F.min_by, F.max_by))
    named = lambda df, word: df.select(F.concat(F.lit(word), F.col("label").cast("string")).alias("name"), "embedding")
    vectors = e.select(F.concat(F.lit("measure "), F.col("vec_id").cast("string")).alias("attribute_canon"), "embedding")
    return ingest.normalization_stage(extracted, aliases, makers.select("name"), vectors, named(first, "metric-"), named(last, "legacy-"), 0.25)


def normalization_stage(spark, folder):
    return _normalization(spark, folder)[0].select("fact_id", "entity_canon", "attribute_canon", "norm_value", "period")


QUERIES["normalization_stage"] = normalization_stage
_WORD = "translate(substr(md5('{salt}' || {number}), 1, 12), '0123456789', 'ghijklmnop')"
_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"
NORMALIZATION_SQL = f"""
p AS (SELECT p_partkey AS k, p_partkey % (SELECT count(*) FROM supplier) AS s, p_partkey % (SELECT count(*) FROM embeddings) AS v FROM part),
w AS (SELECT *, {_WORD.format(salt='s', number='s')} AS m, {_WORD.format(salt='n', number='(k % 50)')} AS n FROM p),
named AS (SELECT k, v, CASE k % 4 WHEN 3 THEN 'Newco ' || upper(n[1]) || n[2:] ELSE 'Maker ' || upper(m[1]) || m[2:] END AS entity_canon,
          CASE k % 4 WHEN 1 THEN NULL WHEN 2 THEN 'maker ' || m[:11] WHEN 3 THEN 'newco ' || n ELSE 'maker ' || m END AS alias FROM w)"""
ORACLES["normalization_stage"] = f"""
WITH {NORMALIZATION_SQL},
ex AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
la AS (SELECT label, arg_max(embedding, vec_id) AS q FROM embeddings GROUP BY label),
bm AS (SELECT vec_id, 'metric-' || ex.label AS name, {_COS} AS sim FROM embeddings e CROSS JOIN ex WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1),
bl AS (SELECT vec_id, 'legacy-' || la.label AS name, {_COS} AS sim FROM embeddings e CROSS JOIN la WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1)
SELECT k AS fact_id, entity_canon, coalesce(bm.name, bl.name, 'measure ' || v) AS attribute_canon, CAST(5e6 AS DOUBLE) AS norm_value, 'FY2024' AS period
FROM named LEFT JOIN bm ON bm.vec_id = v LEFT JOIN bl ON bl.vec_id = v
"""


def normalization_aliases(spark, folder):
    return _normalization(spark, folder)[1]


QUERIES["normalization_aliases"] = normalization_aliases
ORACLES["normalization_aliases"] = f"""
WITH {NORMALIZATION_SQL}
SELECT DISTINCT alias, entity_canon AS canonical FROM named WHERE alias IS NOT NULL
"""


def known_canonicals(spark, folder):
    supplier = read_table(spark, folder, "supplier")
    entities_table = supplier.select((F.col("s_nationkey") % 7).cast("string").alias("canonical_name"))
    return entities.known_canonicals(entities_table, supplier.select(F.col("s_name").alias("canonical")))


QUERIES["known_canonicals"] = known_canonicals
ORACLES["known_canonicals"] = "SELECT DISTINCT CAST(s_nationkey % 7 AS VARCHAR) AS name FROM supplier"


def _misspelled(spark, folder):
    """Part names with their brand, some with a letter dropped or doubled, and words swapped."""
    p = read_table(spark, folder, "part")
    k, n, b = F.col("p_partkey"), F.col("p_name"), F.regexp_replace("p_brand", "#", " ")
    full = F.concat_ws(" ", n, b, F.col("p_type"))
    return p.select(F.lower(_pick(
        k, full, F.concat_ws(" ", b, n, F.col("p_type")), F.concat(F.substring(full, 1, 3), F.expr("substring(concat_ws(' ', p_name, regexp_replace(p_brand, '#', ' '), p_type), 5)")),
        F.concat(F.substring(full, 1, 4), F.expr("substring(concat_ws(' ', p_name, regexp_replace(p_brand, '#', ' '), p_type), 4)")))).alias("name")).distinct()


QUERIES["fuzzy_entities"] = lambda spark, folder: entities.canonical_names(_misspelled(spark, folder))


def fuzzy_lookup(spark, folder):
    p = read_table(spark, folder, "part")
    stored = p.select(F.lower(F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "#", " "), "p_type")).alias("name")).distinct()
    return entities.best_canonical(_misspelled(spark, folder), stored)


QUERIES["fuzzy_lookup"] = fuzzy_lookup


def _text_facts(spark, folder):
    o = read_table(spark, folder, "orders")
    said = F.when(F.col("o_orderstatus") == "F", "Director resigned from office").when(
        F.col("o_orderstatus") == "O", "Director continues in office").otherwise(
        F.concat(F.lit("Registered office at 12 Hill Road "), (F.lit(560000) + F.col("o_orderkey") % 3).cast("string")))
    return o.select(F.col("o_orderkey").cast("string").alias("fact_id"), F.col("o_custkey").cast("string").alias("entity_canon"),
                    F.lit("director_status").alias("attribute_canon"), said.alias("raw_value"),
                    F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")).alias("period"), F.lit(0.9).alias("confidence"))


def reconcile_text_pairs(spark, folder):
    met = pairs.pair_up(_text_facts(spark, folder), ["entity_canon", "attribute_canon", "period"])
    return reconcile.apply_rules(met).select("a_fact_id", "b_fact_id", "relation", F.array_join("rules", ",").alias("rules"))


QUERIES["reconcile_text_pairs"] = reconcile_text_pairs
ORACLES["reconcile_text_pairs"] = """
WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS c, year(o_orderdate) AS y, o_orderstatus AS s FROM orders),
p AS (SELECT a.id AS a_fact_id, b.id AS b_fact_id, a.s AS sa, b.s AS sb FROM f a JOIN f b ON a.c = b.c AND a.y = b.y AND a.id < b.id)
SELECT a_fact_id, b_fact_id,
  CASE WHEN sa = sb THEN 'corroborates' WHEN sa IN ('F', 'O') AND sb IN ('F', 'O') THEN 'contradicts' ELSE 'needs_review' END AS relation,
  CASE WHEN sa = sb THEN 'R5:string_match' WHEN sa = 'F' AND sb = 'O' THEN 'R5:verb_opposition:resigned_vs_continues'
       WHEN sa = 'O' AND sb = 'F' THEN 'R5:verb_opposition:continues_vs_resigned' ELSE 'R5:unmatched_text' END AS rules
FROM p
"""


def _report_chunks(spark, folder):
    p = read_table(spark, folder, "part")
    q = F.col("p_retailprice").cast("decimal(18,2)")
    body = _says("Summary of FY2023\nRevenue growth was $", q, " million and more\nshort\n  Operating margin: ", F.col("p_size"),
                 "%\nNet debt stood at (", q, ") crore for ", F.col("p_name"))
    return p.select(F.col("p_partkey").cast("string").alias("chunk_id"), body.alias("text"), F.lit(None).cast("string").alias("heading"))


def heuristic_facts(spark, folder):
    return text.heuristic_facts(_report_chunks(spark, folder)).select("chunk_id", "attribute", "raw_value", "period", "quote", "confidence")


QUERIES["heuristic_facts"] = heuristic_facts
ORACLES["heuristic_facts"] = """
WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS q, p_size AS s, p_name AS n FROM part)
SELECT chunk_id, 'Revenue growth' AS attribute, '$' || q || ' million' AS raw_value, 'FY2023' AS period,
       'Revenue growth was $' || q || ' million and more' AS quote, CAST(0.75 AS DOUBLE) AS confidence FROM t
UNION ALL SELECT chunk_id, 'Operating margin', s || '%', 'FY2023', 'Operating margin: ' || s || '%', CAST(0.75 AS DOUBLE) FROM t
UNION ALL SELECT chunk_id, 'Net debt', '(' || q || ') cr', 'FY2023', 'Net debt stood at (' || q || ') crore for ' || n, CAST(0.75 AS DOUBLE) FROM t
"""


def safe_decimals(spark, folder):
    p = read_table(spark, folder, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    stated = F.when(F.col("p_size") % 5 == 0, F.lit("n/a")).when(F.col("p_size") % 5 == 1, F.concat(F.lit("-"), price)).when(
        F.col("p_size") % 5 == 2, F.lit("")).when(F.col("p_size") % 5 == 3, F.concat(F.lit("12"), price)).otherwise(F.lit(None).cast("string"))
    return p.select("p_partkey", numbers.safe_decimal(stated).cast("double").alias("value"))


QUERIES["safe_decimals"] = safe_decimals
ORACLES["safe_decimals"] = """
SELECT p_partkey, CAST(TRY_CAST(CASE p_size % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '-' || CAST(p_retailprice AS DECIMAL(18,2)) WHEN 2 THEN ''
  WHEN 3 THEN '12' || CAST(p_retailprice AS DECIMAL(18,2)) END AS DECIMAL(38,10)) AS DOUBLE) AS value FROM part
"""


def quote_check(spark, folder):
    """A quote of 40 to 160 letters from anywhere in each text: as it stands, with every twentieth
    letter changed, or with every other letter changed (never found), by doc_id."""
    d = read_table(spark, folder, "documents").select("doc_id", "text", F.length("text").alias("n"))
    placed = d.selectExpr("doc_id", "text", "cast(pmod(doc_id * 7919, greatest(n - 160, 1)) as int) as start", "cast(40 + doc_id % 121 as int) as size")
    taken = placed.select("doc_id", "text", F.expr("translate(substring(text, start + 1, size), 'aeiou', 'AEIOU')").alias("taken"))
    altered = lambda every: F.regexp_replace("taken", f"(?s)(.{{{every - 1}}}).", "$1\u00a4")
    quote = F.when(F.col("doc_id") % 3 == 0, F.col("taken")).when(F.col("doc_id") % 3 == 1, altered(20)).otherwise(altered(2))
    return taken.select("doc_id", text.verified_confidence(quote, F.col("text"), F.lit(0.9)).alias("confidence"))


QUERIES["quote_check"] = quote_check
# A quote of L letters of which floor(L / k) are changed to one that no text has shares at most the
# others: a ratio of 95 or more for k = 20, and of about half for k = 2. Texts of fewer than two letters have nothing to change.
ORACLES["quote_check"] = """
SELECT doc_id, CASE WHEN doc_id % 3 < 2 OR coalesce(length(text), 0) < 2 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS confidence FROM documents
"""
