"""Queries on pairs of facts: candidates, rules, relations, matrix, tie-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.catalog import views
from factweave.operators import counting, pairs, reconcile, relations, tieouts
from factweave.sources import facts as facts_of

QUERIES: dict = {}
ORACLES: dict = {}

PAIR_KEYS = ["entity_canon", "attribute_canon"]


def _context(spark, folder):
    """The context facts, derived once and read by every branch of a query."""
    return facts_of.stored(facts_of.context_facts(spark, folder), "context-facts")


def fact_scan_enriched(spark, folder):
    facts = facts_of.enrich(
        facts_of.order_facts(spark, folder), facts_of.source_documents(spark, folder), facts_of.source_chunks(spark, folder)
    )
    return facts.filter(F.col("document_id").isin("1-URGENT", "2-HIGH", "5-LOW") & (F.col("attribute_canon") == "total_revenue")).select(
        "fact_id", "document_id", "filename", "entity_canon", "attribute_canon", "period", "norm_value", "page"
    )


QUERIES["fact_scan_enriched"] = fact_scan_enriched
ORACLES["fact_scan_enriched"] = f"""
WITH {views.ORDER_FACTS},
docs AS (SELECT DISTINCT o_orderpriority AS document_id, o_orderpriority || '.pdf' AS filename FROM orders),
chunks AS (SELECT DISTINCT o_orderpriority || '/' || (o_custkey % 50) AS chunk_id,
                  CAST(o_custkey % 50 + 1 AS INTEGER) AS chunk_page FROM orders)
SELECT f.fact_id, f.document_id, d.filename, f.entity_canon, f.attribute_canon, f.period, f.norm_value,
       coalesce(f.page_number, c.chunk_page) AS page
FROM facts f JOIN docs d USING (document_id) LEFT JOIN chunks c USING (chunk_id)
WHERE f.document_id IN ('1-URGENT', '2-HIGH', '5-LOW') AND f.attribute_canon = 'total_revenue'
"""


def candidate_pairs_exact(spark, folder):
    facts = facts_of.stored(facts_of.order_facts(spark, folder).select("fact_id", "document_id", "entity_canon", "attribute_canon", "period"))
    known = pairs.pair_up(facts.filter(F.col("period") == "FY1995"), ["entity_canon", "attribute_canon"]).select(
        F.col("b_fact_id").alias("fact_a"), F.col("a_fact_id").alias("fact_b")
    )
    found = pairs.exact_candidates(facts, known, cross_document_only=True)
    return found.select("entity_canon", "attribute_canon", "a_fact_id", "b_fact_id")


QUERIES["candidate_pairs_exact"] = candidate_pairs_exact
ORACLES["candidate_pairs_exact"] = f"""
WITH {views.ORDER_FACTS}
SELECT a.entity_canon, a.attribute_canon, a.fact_id AS a_fact_id, b.fact_id AS b_fact_id
FROM facts a JOIN facts b ON a.entity_canon = b.entity_canon AND a.attribute_canon = b.attribute_canon
 AND a.fact_id < b.fact_id AND a.document_id <> b.document_id
WHERE NOT (a.period = 'FY1995' AND b.period = 'FY1995')
"""


def _context_relations(spark, folder, explain=False):
    facts = _context(spark, folder)
    compared = facts.select(*reconcile.COMPARED, "entity_canon", "attribute_canon")
    return facts, reconcile.apply_rules_by_kind(pairs.pair_up(reconcile.prepared(compared), PAIR_KEYS), explain=explain)


def reconcile_pairs(spark, folder):
    facts = _context(spark, folder).select(*reconcile.COMPARED, "entity_canon", "attribute_canon")
    ruled = reconcile.apply_rules_by_kind(pairs.exact_candidates(reconcile.prepared(facts)), explain=False)
    return ruled.select(
        "entity_canon", "attribute_canon", "a_fact_id", "b_fact_id", "relation",
        F.array_join("rules", ",").alias("rules"), F.col("relation_confidence").alias("confidence"),
    )


QUERIES["reconcile_pairs"] = reconcile_pairs
ORACLES["reconcile_pairs"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES}
SELECT entity_canon, attribute_canon, a_fact_id, b_fact_id, relation, rules, confidence FROM ruled
"""


def relation_counts(spark, folder):
    return counting.relation_counts(_context(spark, folder))


QUERIES["relation_counts"] = relation_counts
ORACLES["relation_counts"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES}
SELECT relation, CAST(count(*) AS BIGINT) AS n_pairs FROM ruled GROUP BY relation
"""


def relation_ledger(spark, folder):
    return reconcile.relation_ledger(_context(spark, folder)).drop("rules")


QUERIES["relation_ledger"] = relation_ledger
ORACLES["relation_ledger"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES},
claim AS (SELECT fact_id, min(fact_id) OVER (PARTITION BY entity_canon, attribute_canon, period, scope, currency, norm_unit, norm_value,
          CASE WHEN norm_value IS NULL THEN lower(trim(raw_value)) END, coalesce(nullif(confidence, 0), 1) < 0.5) AS claim_id FROM facts),
named AS (SELECT r.*, ka.claim_id AS ka, kb.claim_id AS kb FROM ruled r JOIN claim ka ON ka.fact_id = a_fact_id JOIN claim kb ON kb.fact_id = b_fact_id)
SELECT entity_canon, attribute_canon, least(ka, kb) AS a_fact_id, greatest(ka, kb) AS b_fact_id, relation, count(*) AS n_pairs
FROM named WHERE ca >= 0.5 AND cb >= 0.5 AND a_period = b_period GROUP BY ALL
UNION ALL
SELECT entity_canon, attribute_canon, NULL, NULL, relation, count(*) FROM named WHERE ca < 0.5 OR cb < 0.5 OR a_period <> b_period GROUP BY ALL
"""


def matrix_of_facts(spark, folder):
    return relations.matrix_of_facts(_context(spark, folder))


QUERIES["matrix_of_facts"] = matrix_of_facts
_RELATION_COUNTS = ", ".join(f"count(CASE WHEN relation = '{r}' THEN 1 END) AS n_{r}" for r in ["contradicts", "contextual_variance", "needs_review", "corroborates"])
ORACLES["matrix_of_facts"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES},
cells AS (SELECT entity_canon, attribute_canon, count(*) AS n_facts FROM facts GROUP BY ALL),
counts AS (SELECT c.entity_canon, c.attribute_canon, c.n_facts, {_RELATION_COUNTS}
           FROM cells c LEFT JOIN ruled r ON r.entity_canon = c.entity_canon AND r.attribute_canon = c.attribute_canon GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_contradicts > 0 THEN 'contradicts' WHEN n_contextual_variance > 0 THEN 'contextual_variance'
               WHEN n_needs_review > 0 THEN 'needs_review' WHEN n_corroborates > 0 THEN 'corroborates' END AS badge FROM counts
"""


def _stored(spark, folder):
    facts, ruled = _context_relations(spark, folder)
    return facts, reconcile.as_relations(ruled, [*PAIR_KEYS, *[f"{s}_{c}" for s in "ab" for c in relations.CARRIED]])


def relations_expanded(spark, folder):
    facts, stored = _stored(spark, folder)
    rows = relations.expand_relations(stored, facts, facts_of.source_documents(spark, folder), "contradicts", "3-MEDIUM")
    return rows.select("fact_a", "fact_b", "relation", "confidence", "a_entity", "a_attribute", "a_value", "a_filename",
                       "b_value", "b_filename")


QUERIES["relations_expanded"] = relations_expanded
ORACLES["relations_expanded"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES},
docs AS (SELECT DISTINCT o_orderpriority AS document_id, o_orderpriority || '.pdf' AS filename FROM orders)
SELECT r.a_fact_id AS fact_a, r.b_fact_id AS fact_b, r.relation, r.confidence, fa.entity_canon AS a_entity,
       fa.attribute_canon AS a_attribute, fa.raw_value AS a_value, da.filename AS a_filename,
       fb.raw_value AS b_value, db.filename AS b_filename
FROM ruled r JOIN facts fa ON fa.fact_id = r.a_fact_id JOIN facts fb ON fb.fact_id = r.b_fact_id
JOIN docs da ON da.document_id = fa.document_id JOIN docs db ON db.document_id = fb.document_id
WHERE r.relation = 'contradicts' AND (fa.document_id = '3-MEDIUM' OR fb.document_id = '3-MEDIUM')
"""


def fact_counterparts(spark, folder):
    facts, stored = _stored(spark, folder)
    rows = relations.counterparts(stored, facts, facts_of.source_documents(spark, folder))
    return rows.select("fact_id", "counterpart_id", "relation", "counterpart_value", "counterpart_period",
                       "counterpart_scope", "counterpart_filename")


QUERIES["fact_counterparts"] = fact_counterparts
ORACLES["fact_counterparts"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES},
ends AS (SELECT a_fact_id AS fact_id, b_fact_id AS counterpart_id, relation FROM ruled
         UNION ALL SELECT b_fact_id, a_fact_id, relation FROM ruled)
SELECT e.fact_id, e.counterpart_id, e.relation, f.raw_value AS counterpart_value, f.period AS counterpart_period,
       f.scope AS counterpart_scope, f.document_id || '.pdf' AS counterpart_filename
FROM ends e JOIN facts f ON f.fact_id = e.counterpart_id
"""


def relation_summaries(spark, folder):
    facts, stored = _stored(spark, folder)
    rows = relations.with_relation_summary(facts.select("fact_id", "document_id"), stored)
    return rows.select("fact_id", "document_id", F.array_join("relations_summary", ",").alias("relations_summary"))


QUERIES["relation_summaries"] = relation_summaries
ORACLES["relation_summaries"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES},
ends AS (SELECT a_fact_id AS fact_id, relation FROM ruled UNION SELECT b_fact_id, relation FROM ruled)
SELECT f.fact_id, f.document_id, coalesce(string_agg(e.relation, ',' ORDER BY e.relation), '') AS relations_summary
FROM facts f LEFT JOIN ends e USING (fact_id) GROUP BY f.fact_id, f.document_id
"""


def entity_attribute_matrix(spark, folder):
    facts, stored = _stored(spark, folder)
    return relations.entity_matrix(facts, stored)


QUERIES["entity_attribute_matrix"] = entity_attribute_matrix
ORACLES["entity_attribute_matrix"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES},
ends AS (SELECT a_fact_id AS fact_id, relation FROM ruled UNION SELECT b_fact_id, relation FROM ruled),
ranked AS (SELECT fact_id, min(CASE relation WHEN 'contradicts' THEN 1 WHEN 'contextual_variance' THEN 2
                                WHEN 'needs_review' THEN 3 ELSE 4 END) AS rk FROM ends GROUP BY fact_id)
SELECT f.entity_canon, f.attribute_canon, count(*) AS n_facts, min(f.fact_id) AS first_fact_id,
       CASE min(rk) WHEN 1 THEN 'contradicts' WHEN 2 THEN 'contextual_variance' WHEN 3 THEN 'needs_review'
            WHEN 4 THEN 'corroborates' END AS badge
FROM facts f LEFT JOIN ranked r USING (fact_id) GROUP BY f.entity_canon, f.attribute_canon
"""


def tieout_findings(spark, folder):
    found = tieouts.cross_document_findings(_context(spark, folder))
    return found.select(
        "case_id", "category", "severity",
        F.col("fact_ids")[0].alias("fact_a"), F.col("fact_ids")[1].alias("fact_b"),
        F.array_join("document_ids", ",").alias("document_ids"),
        F.get_json_object("details", "$.rel_delta_pct").cast("double").alias("rel_delta_pct"),
    )


QUERIES["tieout_findings"] = tieout_findings
ORACLES["tieout_findings"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs(cross_document=True)}, {views.RULES},
stated AS (SELECT DISTINCT entity_canon, attribute_canon, document_id, period FROM facts),
kept AS (
  SELECT r.* FROM ruled r
  LEFT JOIN stated sb ON sb.entity_canon = r.entity_canon AND sb.attribute_canon = r.attribute_canon
        AND sb.document_id = r.b_document_id AND sb.period = r.a_period
  LEFT JOIN stated sa ON sa.entity_canon = r.entity_canon AND sa.attribute_canon = r.attribute_canon
        AND sa.document_id = r.a_document_id AND sa.period = r.b_period
  WHERE r.relation <> 'corroborates' AND (r.a_period = r.b_period OR (sa.period IS NULL AND sb.period IS NULL))
),
deltas AS (SELECT *, coalesce(abs(a_norm_value - b_norm_value) / greatest(abs(a_norm_value), abs(b_norm_value), CAST(1e-9 AS DOUBLE)), 0) AS d FROM kept)
SELECT sha256(entity_canon || '|' || attribute_canon) AS case_id,
       CASE WHEN relation = 'contextual_variance' THEN 'contextual_variance' ELSE 'contradiction' END AS category,
       CASE WHEN relation = 'contextual_variance' THEN 'info' WHEN relation = 'needs_review' THEN 'low'
            WHEN d > 0.5 THEN 'critical' WHEN d > 0.1 THEN 'high' WHEN d > 0.05 THEN 'medium' ELSE 'low' END AS severity,
       a_fact_id AS fact_a, b_fact_id AS fact_b,
       least(a_document_id, b_document_id) || ',' || greatest(a_document_id, b_document_id) AS document_ids,
       CASE WHEN relation = 'contradicts' THEN round(d * 100, 2) END AS rel_delta_pct
FROM deltas
"""


def intra_document_conflicts(spark, folder):
    found = tieouts.intra_document_findings(facts_of.line_facts(spark, folder))
    return found.select(
        "case_id", "severity", F.col("fact_ids")[0].alias("fact_a"), F.col("fact_ids")[1].alias("fact_b"),
        F.col("document_ids")[0].alias("document_id"),
        F.get_json_object("details", "$.rel_delta_pct").cast("double").alias("rel_delta_pct"),
    )


QUERIES["intra_document_conflicts"] = intra_document_conflicts
ORACLES["intra_document_conflicts"] = f"""
WITH {views.LINE_FACTS},
pairs AS (
  SELECT a.entity_canon, a.attribute_canon, a.document_id, a.fact_id AS fact_a, b.fact_id AS fact_b,
         abs(a.norm_value - b.norm_value) / greatest(abs(a.norm_value), abs(b.norm_value), CAST(1e-9 AS DOUBLE)) AS d
  FROM facts a JOIN facts b ON a.entity_canon = b.entity_canon AND a.document_id = b.document_id AND a.fact_id < b.fact_id
  WHERE a.period = b.period AND (a.scope IS NULL OR b.scope IS NULL OR a.scope = b.scope)
)
SELECT sha256(entity_canon || '|' || attribute_canon) AS case_id,
       CASE WHEN d > 0.5 THEN 'critical' WHEN d > 0.1 THEN 'high' WHEN d > 0.05 THEN 'medium' ELSE 'low' END AS severity,
       fact_a, fact_b, document_id, round(d * 100, 2) AS rel_delta_pct
FROM pairs WHERE d > 0.01
"""
