"""Queries on statistical checks, disclosures and calculations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.catalog import views
from factweave.functions.numbers import compact
from factweave.operators import anomalies, calculations, disclosures
from factweave.operators.ordered import previous_row
from factweave.sources import facts as facts_of
from factweave.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict = {}


def period_swings(spark, folder):
    rows = anomalies.period_swings(facts_of.order_facts(spark, folder))
    return rows.select("fact_id", "document_id", "severity", F.col("previous.fact_id").alias("previous_fact_id"),
                       F.round(F.col("change") * 100, 2).alias("pct_change"))


QUERIES["period_swings"] = period_swings
ORACLES["period_swings"] = f"""
WITH {views.ORDER_FACTS},
w AS (SELECT *, lag(norm_value) OVER o AS pv, lag(fact_id) OVER o AS pf FROM facts
      WINDOW o AS (PARTITION BY document_id, entity_canon, attribute_canon ORDER BY period, coalesce(page_number, 0), fact_id)),
c AS (SELECT *, abs(norm_value - pv) / abs(pv) AS change FROM w WHERE abs(pv) >= 1e-9)
SELECT fact_id, document_id, CASE WHEN change > 1.0 THEN 'high' ELSE 'medium' END AS severity, pf AS previous_fact_id,
       round(change * 100, 2) AS pct_change
FROM c WHERE change > 0.5
"""


def period_changes(spark, folder):
    rows = anomalies.period_changes(facts_of.order_facts(spark, folder))
    return rows.select("fact_id", F.col("previous.fact_id").alias("previous_fact_id"), "severity", "direction",
                       F.col("previous.period").alias("previous_period"), F.col("period").alias("current_period"),
                       F.round(F.col("change") * 100, 2).alias("pct_change"))


QUERIES["period_changes"] = period_changes
ORACLES["period_changes"] = f"""
WITH {views.ORDER_FACTS},
w AS (SELECT *, lag(norm_value) OVER o AS pv, lag(fact_id) OVER o AS pf, lag(period) OVER o AS pp FROM facts
      WINDOW o AS (PARTITION BY entity_canon, attribute_canon ORDER BY period, document_id, coalesce(page_number, 0), fact_id)),
c AS (SELECT *, (norm_value - pv) / abs(pv) AS change FROM w WHERE abs(pv) >= 1e-9)
SELECT fact_id, pf AS previous_fact_id, CASE WHEN abs(change) > 1.0 THEN 'critical' ELSE 'high' END AS severity,
       CASE WHEN change > 0 THEN 'increased' ELSE 'decreased' END AS direction, pp AS previous_period, period AS current_period,
       round(change * 100, 2) AS pct_change
FROM c WHERE abs(change) > 0.5
"""


def zscore_outliers(spark, folder):
    rows = anomalies.zscore_outliers(facts_of.event_facts(spark, folder))
    return rows.select("fact_id", "document_id", "severity", "norm_value", F.round("z_score", 4).alias("z_score"),
                       F.round("group_mean", 4).alias("group_mean"), F.round("group_stdev", 4).alias("group_stdev"), "group_size")


QUERIES["zscore_outliers"] = zscore_outliers
ORACLES["zscore_outliers"] = f"""
WITH {views.EVENT_FACTS},
s AS (SELECT document_id, entity_canon, attribute_canon, avg(norm_value) AS m, stddev_samp(norm_value) AS sd, count(*) AS n
      FROM facts WHERE norm_value IS NOT NULL GROUP BY ALL),
z AS (SELECT f.*, m, sd, n, abs(norm_value - m) / sd AS z FROM facts f JOIN s USING (document_id, entity_canon, attribute_canon)
      WHERE n >= 3 AND sd >= 1e-9)
SELECT fact_id, document_id, CASE WHEN z > 5 THEN 'high' ELSE 'medium' END AS severity, norm_value, round(z, 4) AS z_score,
       round(m, 4) AS group_mean, round(sd, 4) AS group_stdev, CAST(n AS BIGINT) AS group_size
FROM z WHERE z > 3
"""


def benford_by_document(spark, folder):
    events = facts_of.event_facts(spark, folder).select("document_id", "norm_value")
    balances = facts_of.balance_facts(spark, folder).select("document_id", "norm_value")
    prices = facts_of.order_facts(spark, folder).select("document_id", "norm_value")
    rows = anomalies.first_digit_check(events.unionByName(balances).unionByName(prices), everything=True)
    return rows.select("document_id", "sample_size", F.round("chi_squared", 4).alias("chi_squared"), "severity",
                       F.array_join(F.col("worst_digits").cast("array<string>"), ",").alias("worst_digits"))


QUERIES["benford_by_document"] = benford_by_document
ORACLES["benford_by_document"] = f"""
WITH {views.ORDER_FACTS},
pool AS (SELECT event_type AS document_id, value AS v FROM events
         UNION ALL SELECT c_mktsegment, c_acctbal FROM customer
         UNION ALL SELECT document_id, norm_value FROM facts),
digits AS (SELECT document_id, CAST(regexp_extract(CAST(abs(v) AS VARCHAR), '[1-9]', 0) AS INTEGER) AS digit
           FROM pool WHERE v IS NOT NULL AND v <> 0),
expected AS (SELECT * FROM (VALUES (1, 0.301), (2, 0.176), (3, 0.125), (4, 0.097), (5, 0.079), (6, 0.067), (7, 0.058), (8, 0.051), (9, 0.046)) t(digit, share0)),
e AS (SELECT digit, CAST(share0 AS DOUBLE) AS share FROM expected),
sizes AS (SELECT document_id, count(*) AS n FROM digits GROUP BY document_id HAVING count(*) >= 20),
obs AS (SELECT s.document_id, s.n, e.digit, e.share, CAST(count(d.digit) AS DOUBLE) AS o
        FROM sizes s CROSS JOIN e LEFT JOIN digits d ON d.document_id = s.document_id AND d.digit = e.digit
        GROUP BY s.document_id, s.n, e.digit, e.share),
chi AS (SELECT document_id, n, sum((o - share * n) * (o - share * n) / (share * n)) AS chi FROM obs GROUP BY document_id, n),
worst AS (SELECT document_id, digit, row_number() OVER (PARTITION BY document_id ORDER BY abs(o / n - share) DESC, digit) AS r FROM obs)
SELECT c.document_id, CAST(c.n AS BIGINT) AS sample_size, round(chi, 4) AS chi_squared,
       CASE WHEN chi > 25 THEN 'high' WHEN chi > 15.5 THEN 'medium' END AS severity,
       (SELECT string_agg(CAST(digit AS VARCHAR), ',' ORDER BY r) FROM worst w WHERE w.document_id = c.document_id AND r <= 3) AS worst_digits
FROM chi c
"""


def cross_foot_check(spark, folder):
    rows = anomalies.cross_foot_check(facts_of.status_facts(spark, folder))
    return rows.select("document_id", "entity_canon", "period", "total_attribute", "line_items", "fact_id", "severity",
                       F.round("computed_sum", 4).alias("computed_sum"), F.round("reported_total", 4).alias("reported_total"),
                       F.round(F.col("relative_diff") * 100, 2).alias("relative_diff_pct"))


QUERIES["cross_foot_check"] = cross_foot_check
ORACLES["cross_foot_check"] = f"""
WITH {views.STATUS_FACTS},
patterns AS (SELECT * FROM (VALUES ('current_assets', 'non_current_assets', 'total_assets'), ('current_liabilities', 'non_current_liabilities', 'total_liabilities'),
   ('total_liabilities', 'total_equity', 'total_assets'), ('total_liabilities', 'shareholders_equity', 'total_assets')) t(i1, i2, tot)),
j AS (SELECT t.document_id, t.entity_canon, t.period, p.tot AS total_attribute, p.i1 || ',' || p.i2 AS line_items, t.fact_id,
             a.norm_value + b.norm_value AS computed, t.norm_value AS reported
      FROM patterns p JOIN facts t ON t.attribute_canon = p.tot
      JOIN facts a ON a.attribute_canon = p.i1 AND a.document_id = t.document_id AND a.entity_canon = t.entity_canon AND a.period = t.period
      JOIN facts b ON b.attribute_canon = p.i2 AND b.document_id = t.document_id AND b.entity_canon = t.entity_canon AND b.period = t.period
      WHERE t.norm_value IS NOT NULL AND a.norm_value IS NOT NULL AND b.norm_value IS NOT NULL AND abs(t.norm_value) >= 1e-9),
d AS (SELECT *, abs(computed - reported) / abs(reported) AS rel FROM j)
SELECT document_id, entity_canon, period, total_attribute, line_items, fact_id, CASE WHEN rel > 0.2 THEN 'critical' ELSE 'high' END AS severity,
       round(computed, 4) AS computed_sum, round(reported, 4) AS reported_total, round(rel * 100, 2) AS relative_diff_pct
FROM d WHERE rel > 0.01
"""


def metric_sets(spark, folder):
    rows = disclosures.metric_sets(facts_of.metric_facts(spark, folder))
    return rows.select("entity_canon", "period", "document_id", "filename", F.array_join("metrics", ",").alias("metrics"))


QUERIES["metric_sets"] = metric_sets
ORACLES["metric_sets"] = f"""
WITH {views.METRIC_FACTS}, d AS (SELECT DISTINCT entity_canon, period, document_id, filename, attribute_canon FROM facts)
SELECT entity_canon, period, document_id, filename, string_agg(attribute_canon, ',' ORDER BY attribute_canon) AS metrics
FROM d GROUP BY entity_canon, period, document_id, filename
"""


def missing_disclosures(spark, folder):
    return disclosures.missing_disclosures(disclosures.metric_sets(facts_of.metric_facts(spark, folder)))


QUERIES["missing_disclosures"] = missing_disclosures
ORACLES["missing_disclosures"] = f"""
WITH {views.METRIC_FACTS}, d AS (SELECT DISTINCT entity_canon, period, document_id, filename, attribute_canon FROM facts),
docs AS (SELECT DISTINCT entity_canon, period, document_id, filename FROM facts)
SELECT l.entity_canon, l.period, l.document_id, l.filename AS absent_from, p.filename AS present_in, p.attribute_canon AS missing_metric
FROM docs l JOIN d p ON p.entity_canon = l.entity_canon AND p.period = l.period AND p.document_id <> l.document_id
WHERE p.attribute_canon IN ('total_revenue', 'ebitda', 'net_income', 'total_assets')
  AND NOT EXISTS (SELECT 1 FROM d o WHERE o.entity_canon = l.entity_canon AND o.period = l.period AND o.document_id = l.document_id
                  AND o.attribute_canon = p.attribute_canon)
"""

RATIOS = [
    ("net_profit_margin", "net_income", "total_revenue"),
    ("current_ratio", "current_assets", "current_liabilities"),
    ("debt_to_equity", "total_debt", "total_equity"),
    ("return_on_assets", "net_income", "total_assets"),
]


def _status(spark, folder):
    """What calculations read of the status facts, derived once and read by every branch of a query."""
    names = ["fact_id", "entity_canon", "attribute_canon", "norm_value", "period"]
    return facts_of.stored(facts_of.status_facts(spark, folder).select(*names), "status-facts")


def _ratio_requests(facts):
    base = facts.filter(F.col("attribute_canon") == "total_revenue").select(
        F.regexp_replace("fact_id", r"total_revenue$", "").alias("stem")
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(n).alias("formula_name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in RATIOS
    ]))
    return base.withColumn("r", wanted).select(
        F.concat("stem", "r.formula_name").alias("calc_id"), "r.formula_name",
        F.concat("stem", "r.a").alias("numerator_id"), F.concat("stem", "r.b").alias("denominator_id"),
    )


def calc_ratio(spark, folder):
    facts = _status(spark, folder)
    rows = calculations.calculate_ratio(_ratio_requests(facts), facts)
    return rows.select("calc_id", "formula", F.col("result").cast("double").alias("result"), "result_unit", "error")


QUERIES["calc_ratio"] = calc_ratio
_RATIO_VALUES = ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in RATIOS)
RATIO_SQL = f"""
req AS (SELECT * FROM (VALUES {_RATIO_VALUES}) t(formula_name, na, da)),
base AS MATERIALIZED (SELECT *, CAST(round(norm_value * 100) AS HUGEINT) AS cents FROM facts),
ratios AS (
  SELECT n.document_id || '|' || n.c_custkey || '|' || n.y || '|' || q.formula_name AS calc_id, q.formula_name, n.document_id, n.c_custkey, n.y,
         n.cents AS num, d.cents AS den, n.fact_id AS nf, d.fact_id AS df
  FROM req q JOIN base n ON n.attribute_canon = q.na
  JOIN base d ON d.attribute_canon = q.da AND d.document_id = n.document_id AND d.c_custkey = n.c_custkey AND d.y = n.y
),
quotients AS (
  SELECT *, CASE WHEN num IS NULL OR den IS NULL THEN 'Missing input values' WHEN den = 0 THEN 'Division by zero' END AS error,
    CASE WHEN den <> 0 THEN CAST(sign(num) * sign(den) AS DOUBLE) * CAST((2 * abs(num) * 10000 + abs(den)) // (2 * abs(den)) AS DOUBLE) END AS q4
  FROM ratios
)"""
ORACLES["calc_ratio"] = f"""
WITH {views.STATUS_FACTS}, {RATIO_SQL}
SELECT calc_id, CASE formula_name WHEN 'net_profit_margin' THEN 'net_income / total_revenue' WHEN 'current_ratio' THEN 'current_assets / current_liabilities'
       WHEN 'debt_to_equity' THEN 'total_debt / total_equity' ELSE 'net_income / total_assets' END AS formula,
       CASE WHEN formula_name IN ('net_profit_margin', 'return_on_assets') THEN q4 / 100 ELSE q4 / 10000 END AS result,
       CASE WHEN error IS NULL THEN CASE WHEN formula_name IN ('net_profit_margin', 'return_on_assets') THEN 'pct' ELSE 'ratio' END END AS result_unit,
       error
FROM quotients
"""


def _growth_requests(facts):
    revenue = facts.filter(F.col("attribute_canon") == "cost_of_goods_sold")
    rows = previous_row(revenue, ["entity_canon"], ["period"], ["period", "fact_id"], ["fact_id"])
    return rows.select(F.concat(F.lit("growth|"), "fact_id").alias("calc_id"), F.col("fact_id").alias("current_id"),
                       F.col("previous.fact_id").alias("previous_id"))


def calc_growth(spark, folder):
    facts = _status(spark, folder)
    rows = calculations.calculate_growth(_growth_requests(facts), facts)
    return rows.select("calc_id", "formula", F.col("result").cast("double").alias("result"), "result_unit", "error")


QUERIES["calc_growth"] = calc_growth
GROWTH_SQL = """
growths AS (
  SELECT 'growth|' || fact_id AS calc_id, fact_id, lag(fact_id) OVER w AS pf, CAST(round(norm_value * 100) AS HUGEINT) AS cur,
         lag(CAST(round(norm_value * 100) AS HUGEINT)) OVER w AS prev, y
  FROM facts WHERE attribute_canon = 'cost_of_goods_sold' WINDOW w AS (PARTITION BY entity_canon ORDER BY period)
)"""
ORACLES["calc_growth"] = f"""
WITH {views.STATUS_FACTS}, {GROWTH_SQL}
SELECT calc_id, '(current - previous) / abs(previous)' AS formula,
       CASE WHEN prev <> 0 THEN CAST(sign(cur - prev) AS DOUBLE) * CAST((2 * abs(cur - prev) * 10000 + abs(prev)) // (2 * abs(prev)) AS DOUBLE) / 100 END AS result,
       CASE WHEN prev <> 0 THEN 'pct' END AS result_unit,
       CASE WHEN prev IS NULL THEN 'Missing input values' WHEN prev = 0 THEN 'Previous period value is zero — infinite growth' END AS error
FROM growths
"""


def _foot_requests(facts):
    return facts.filter(F.col("attribute_canon") == "total_assets").select(
        F.concat(F.lit("foot|"), "fact_id").alias("calc_id"),
        F.array(*[F.concat(F.regexp_replace("fact_id", r"total_assets$", ""), F.lit(n)) for n in
                  ("current_assets", "non_current_assets")]).alias("line_item_ids"),
        F.col("fact_id").alias("total_id"),
    )


def calc_cross_foot(spark, folder):
    facts = _status(spark, folder)
    rows = calculations.cross_foot(_foot_requests(facts), facts)
    return rows.select("calc_id", F.col("result").cast("double").alias("result"), "is_verified",
                       F.coalesce(F.substring("error", 1, 8), F.lit("")).alias("error_kind"))


QUERIES["calc_cross_foot"] = calc_cross_foot
FOOT_SQL = """
foots AS (
  SELECT 'foot|' || t.fact_id AS calc_id, t.fact_id AS tf, a.fact_id AS af, b.fact_id AS bf, t.y,
    CASE WHEN a.norm_value IS NULL AND b.norm_value IS NULL THEN NULL
         ELSE coalesce(CAST(round(a.norm_value * 100) AS HUGEINT), 0) + coalesce(CAST(round(b.norm_value * 100) AS HUGEINT), 0) END AS computed,
    CAST(round(t.norm_value * 100) AS HUGEINT) AS expected
  FROM facts t
  JOIN facts a ON a.attribute_canon = 'current_assets' AND a.document_id = t.document_id AND a.c_custkey = t.c_custkey
  JOIN facts b ON b.attribute_canon = 'non_current_assets' AND b.document_id = t.document_id AND b.c_custkey = t.c_custkey
  WHERE t.attribute_canon = 'total_assets'
)"""
ORACLES["calc_cross_foot"] = f"""
WITH {views.STATUS_FACTS}, {FOOT_SQL}
SELECT calc_id, CAST(computed AS DOUBLE) / 100 AS result,
       coalesce(100 * abs(computed - expected) <= abs(expected), false) AS is_verified,
       CASE WHEN computed IS NULL OR expected IS NULL THEN 'Missing '
            WHEN 100 * abs(computed - expected) <= abs(expected) THEN '' ELSE 'Mismatch' END AS error_kind
FROM foots
"""


def calc_formulas(spark, folder):
    rows = calculations.evaluate_formulas(facts_of.status_facts(spark, folder))
    return rows.select("document_id", "entity_canon", "period", "formula_name", F.col("result").cast("double").alias("result"),
                       "result_unit", "error")


QUERIES["calc_formulas"] = calc_formulas
ORACLES["calc_formulas"] = f"""
WITH {views.STATUS_FACTS},
w AS (SELECT document_id, entity_canon, period, {", ".join(
    f"max(CASE WHEN attribute_canon = '{m}' THEN CAST(round(norm_value * 100) AS HUGEINT) END) AS {m}"
    for m in ["net_income", "total_revenue", "cost_of_goods_sold", "total_debt", "total_equity", "current_assets", "current_liabilities", "total_assets"])}
   FROM facts GROUP BY document_id, entity_canon, period),
parts AS (
  SELECT document_id, entity_canon, period, 'net_profit_margin' AS formula_name, net_income AS num, total_revenue AS den, 'pct' AS result_unit FROM w UNION ALL
  SELECT document_id, entity_canon, period, 'gross_profit_margin', total_revenue - cost_of_goods_sold, total_revenue, 'pct' FROM w UNION ALL
  SELECT document_id, entity_canon, period, 'debt_to_equity', total_debt, total_equity, 'ratio' FROM w UNION ALL
  SELECT document_id, entity_canon, period, 'current_ratio', current_assets, current_liabilities, 'ratio' FROM w UNION ALL
  SELECT document_id, entity_canon, period, 'return_on_assets', net_income, total_assets, 'pct' FROM w UNION ALL
  SELECT document_id, entity_canon, period, 'return_on_equity', net_income, total_equity, 'pct' FROM w),
q AS (SELECT *, CASE WHEN den <> 0 THEN CAST(sign(num) * sign(den) AS DOUBLE) * CAST((2 * abs(num) * 10000 + abs(den)) // (2 * abs(den)) AS DOUBLE) END AS q4 FROM parts)
SELECT document_id, entity_canon, period, formula_name, CASE WHEN result_unit = 'pct' THEN q4 / 100 ELSE q4 / 10000 END AS result, result_unit,
       CASE WHEN num IS NULL OR den IS NULL THEN 'Missing input values' WHEN den = 0 THEN 'Division by zero' END AS error
FROM q
"""


def calc_replay(spark, folder):
    facts = _status(spark, folder)
    stored = calculations.calculate_ratio(_ratio_requests(facts), facts).unionByName(
        calculations.calculate_growth(_growth_requests(facts), facts)
    ).unionByName(calculations.cross_foot(_foot_requests(facts), facts))
    # since then, the income facts of 1996 were restated upwards by 10%
    restated = facts.withColumn(
        "norm_value",
        F.when((F.col("period") == "FY1996") & (F.col("attribute_canon") == "net_income"),
               F.round(F.col("norm_value") * 1.1, 2)).otherwise(F.col("norm_value")),
    )
    rows = calculations.verify(stored, restated)
    return rows.select("calc_id", "formula_id", F.col("result").cast("double").alias("result"), "verified")


QUERIES["calc_replay"] = calc_replay
ORACLES["calc_replay"] = f"""
WITH {views.STATUS_FACTS}, {RATIO_SQL}, {GROWTH_SQL}, {FOOT_SQL},
again AS (
  SELECT q.*, CASE WHEN y = 1996 AND formula_name IN ('net_profit_margin', 'return_on_assets')
                   THEN CAST(round(CAST(num AS DOUBLE) / 100 * 1.1, 2) * 100 AS HUGEINT) ELSE num END AS num2 FROM quotients q),
rat AS (SELECT calc_id, 'ratio' AS formula_id, CASE WHEN formula_name IN ('net_profit_margin', 'return_on_assets') THEN q4 / 100 ELSE q4 / 10000 END AS result,
    CASE WHEN formula_name IN ('net_profit_margin', 'return_on_assets') THEN 100 ELSE 1 END AS scale, q4,
    CASE WHEN den <> 0 THEN CAST(sign(num2) * sign(den) AS DOUBLE) * CAST((2 * abs(num2) * 10000 + abs(den)) // (2 * abs(den)) AS DOUBLE) END AS r4 FROM again)
SELECT calc_id, formula_id, result, CASE WHEN q4 IS NULL THEN true ELSE coalesce(abs(r4 - q4) * scale < 100, false) END AS verified FROM rat
UNION ALL
SELECT calc_id, 'growth', CASE WHEN prev <> 0 THEN CAST(sign(cur - prev) AS DOUBLE) * CAST((2 * abs(cur - prev) * 10000 + abs(prev)) // (2 * abs(prev)) AS DOUBLE) / 100 END, true
FROM growths
UNION ALL
SELECT calc_id, 'cross_foot', CAST(computed AS DOUBLE) / 100, true FROM foots
"""


def calculations_by_fact(spark, folder):
    """The calculations in which the fact of the smallest id takes part."""
    facts = facts_of.status_facts(spark, folder)
    stored = calculations.calculate_ratio(_ratio_requests(facts), facts)
    first = facts.filter(F.col("attribute_canon") == "net_income").agg(F.min("fact_id")).first()[0]
    return calculations.calculations_of_fact(stored, first).select("calc_id", "formula")


QUERIES["calculations_by_fact"] = calculations_by_fact
ORACLES["calculations_by_fact"] = f"""
WITH {views.STATUS_FACTS}, {RATIO_SQL}
SELECT calc_id, CASE formula_name WHEN 'net_profit_margin' THEN 'net_income / total_revenue' WHEN 'current_ratio' THEN 'current_assets / current_liabilities'
       WHEN 'debt_to_equity' THEN 'total_debt / total_equity' ELSE 'net_income / total_assets' END AS formula
FROM quotients WHERE (SELECT min(fact_id) FROM facts WHERE attribute_canon = 'net_income') IN (nf, df)
"""


def compact_numbers(spark, folder):
    o = read_table(spark, folder, "orders")
    value = F.sqrt("o_totalprice") / F.element_at(F.array(F.lit(1.0), F.lit(1e9), F.lit(1e-6)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", compact(value).alias("shown"))


QUERIES["compact_numbers"] = compact_numbers
ORACLES["compact_numbers"] = """
SELECT o_orderkey, printf('%g', sqrt(o_totalprice) / [CAST(1.0 AS DOUBLE), CAST(1e9 AS DOUBLE), CAST(1e-6 AS DOUBLE)][CAST(o_orderkey % 3 + 1 AS INTEGER)]) AS shown FROM orders
"""
