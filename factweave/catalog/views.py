"""The derived fact views as plain SQL, shared by the check queries."""

ORDER_GROUPS = """
grp AS MATERIALIZED (
  SELECT o_orderpriority AS document_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p,
         c_custkey, c_name AS entity_canon, CAST(year(o_orderdate) AS INTEGER) AS y,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n, max(c_acctbal) AS c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY o_orderpriority, c_custkey, c_name, year(o_orderdate)
)"""

_COMMON = """
  document_id || '|' || c_custkey || '|' || y || '|' || attribute_canon AS fact_id,
  document_id, entity_canon, attribute_canon, raw_value, norm_value, norm_unit, currency,
  'FY' || y AS period, scope, confidence,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 20 + 1 AS INTEGER) END AS page_number,
  document_id || '/' || (c_custkey % 50) AS chunk_id"""

ORDER_FACTS = ORDER_GROUPS + f""",
facts AS MATERIALIZED (
  SELECT {_COMMON} FROM (
    SELECT *, 'standalone' AS scope, CAST(0.9 AS DOUBLE) AS confidence, 'total_revenue' AS attribute_canon,
           CAST(total AS VARCHAR) AS raw_value, CAST(total AS DOUBLE) AS norm_value, 'currency' AS norm_unit, 'USD' AS currency FROM grp
    UNION ALL
    SELECT *, 'standalone', CAST(0.9 AS DOUBLE), 'order_count', CAST(n AS VARCHAR), CAST(n AS DOUBLE), 'count', NULL FROM grp
    UNION ALL
    SELECT *, 'standalone', CAST(0.9 AS DOUBLE), 'average_order_value', CAST(total AS VARCHAR) || '/' || CAST(n AS VARCHAR),
           CAST(total AS DOUBLE) / CAST(n AS DOUBLE), 'currency', 'USD' FROM grp
  ) s
)"""

CONTEXT_FACTS = ORDER_GROUPS + f""",
ctx AS MATERIALIZED (
  SELECT *,
    CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN p = 2 THEN 'standalone' ELSE 'consolidated' END END AS scope,
    CAST(CASE WHEN p = 1 AND (c_custkey + y) % 11 = 0 THEN 0.4 WHEN (c_custkey + y) % 13 = 0 THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
    CASE WHEN p = 3 THEN 'INR' WHEN p = 4 AND c_custkey % 7 = 0 THEN 'XXX' ELSE 'USD' END AS cur,
    c_acctbal * (CAST(1.0 AS DOUBLE) + CAST((c_custkey + y + p) % 7 AS DOUBLE) / CAST(200.0 AS DOUBLE)) AS bal
  FROM grp
),
facts AS MATERIALIZED (
  SELECT {_COMMON} FROM (
    SELECT *, 'total_revenue' AS attribute_canon, CAST(total AS VARCHAR) AS raw_value,
           CASE WHEN p = 3 THEN CAST(total AS DOUBLE) / CAST(0.012 AS DOUBLE) ELSE CAST(total AS DOUBLE) END AS norm_value,
           'currency' AS norm_unit, cur AS currency FROM ctx
    UNION ALL
    SELECT *, 'account_balance', CAST(c_custkey AS VARCHAR),
           CASE WHEN p = 3 THEN bal / CAST(0.012 AS DOUBLE) ELSE bal END, 'currency', cur FROM ctx
    UNION ALL
    SELECT *, 'order_count', CAST(n AS VARCHAR),
           CASE WHEN p = 5 THEN CAST(least(n, 100) AS DOUBLE) / CAST(100.0 AS DOUBLE) ELSE CAST(n AS DOUBLE) END,
           CASE WHEN p = 5 THEN 'count' ELSE 'pct' END, NULL FROM ctx
    UNION ALL
    SELECT *, 'status_note', ['resigned', 'continues', 'Active', 'office 560001', 'hq at 560001 west'][CAST((c_custkey + p + y) % 5 + 1 AS INTEGER)],
           CAST(NULL AS DOUBLE), 'text', NULL FROM ctx
  ) s
)"""

STATUS_FACTS = """
grp AS MATERIALIZED (
  SELECT c_custkey, c_name AS entity_canon, CAST(year(o_orderdate) AS INTEGER) AS y,
         sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS f,
         sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS o,
         coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), CAST(0 AS DECIMAL(18,2))) AS pend,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_custkey, c_name, year(o_orderdate)
),
facts AS MATERIALIZED (
  SELECT 'statement-' || y || '|' || c_custkey || '|' || y || '|' || attribute_canon AS fact_id,
         'statement-' || y AS document_id, entity_canon, attribute_canon,
         CAST(v AS DOUBLE) AS norm_value, 'FY' || y AS period, c_custkey, y
  FROM (
    SELECT *, 'current_assets' AS attribute_canon, f AS v FROM grp UNION ALL
    SELECT *, 'non_current_assets', o FROM grp UNION ALL
    SELECT *, 'total_assets', total FROM grp UNION ALL
    SELECT *, 'total_liabilities', f FROM grp UNION ALL
    SELECT *, 'total_equity', total - f FROM grp UNION ALL
    SELECT *, 'total_revenue', total FROM grp UNION ALL
    SELECT *, 'net_income', f - pend FROM grp UNION ALL
    SELECT *, 'cost_of_goods_sold', pend FROM grp UNION ALL
    SELECT *, 'total_debt', o FROM grp UNION ALL
    SELECT *, 'current_liabilities', pend FROM grp
  ) s
)"""

METRIC_FACTS = """
facts AS MATERIALIZED (
  SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, o_orderpriority AS document_id, o_orderpriority || '.pdf' AS filename,
         c_name AS entity_canon,
         CASE o_orderkey % 5 WHEN 0 THEN 'total_revenue' WHEN 1 THEN 'ebitda' WHEN 2 THEN 'net_income'
              WHEN 3 THEN 'total_assets' ELSE 'headcount' END AS attribute_canon,
         'FY' || year(o_orderdate) AS period
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

EVENT_FACTS = """
facts AS MATERIALIZED (
  SELECT CAST(event_id AS VARCHAR) AS fact_id, event_type AS document_id, event_type || '-source' AS entity_canon,
         'value' AS attribute_canon, value AS norm_value
  FROM events
)"""

BALANCE_FACTS = """
facts AS MATERIALIZED (
  SELECT CAST(c_custkey AS VARCHAR) AS fact_id, c_mktsegment AS document_id, c_name AS entity_canon,
         'account_balance' AS attribute_canon, c_acctbal AS norm_value
  FROM customer
)"""

LINE_FACTS = """
facts AS MATERIALIZED (
  SELECT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS fact_id,
         'ledger-' || (l_orderkey % 100) AS document_id, 'order-' || l_orderkey AS entity_canon,
         'unit_price' AS attribute_canon, l_extendedprice / l_quantity AS norm_value,
         'FY' || year(l_shipdate) AS period, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS scope,
         l_linenumber AS page_number
  FROM lineitem
)"""

# The pair rules R1 to R5 over rows with columns a_* and b_*; needs a CTE `pairs`.
RULES = """
fx AS (SELECT * FROM (VALUES ('USD', CAST(1.0 AS DOUBLE)), ('INR', CAST(0.012 AS DOUBLE)), ('EUR', CAST(1.08 AS DOUBLE)),
        ('GBP', CAST(1.27 AS DOUBLE)), ('JPY', CAST(0.0067 AS DOUBLE)), ('CNY', CAST(0.14 AS DOUBLE))) t(code, rate)),
axes AS (
  SELECT p.*,
    coalesce(nullif(a_confidence, 0.0), 1.0) AS ca, coalesce(nullif(b_confidence, 0.0), 1.0) AS cb,
    coalesce(upper(trim(a_period)), '') AS pa, coalesce(upper(trim(b_period)), '') AS pb,
    coalesce(lower(trim(a_scope)), '') AS sa, coalesce(lower(trim(b_scope)), '') AS sb,
    coalesce(upper(trim(a_currency)), '') AS cura, coalesce(upper(trim(b_currency)), '') AS curb,
    coalesce(lower(trim(a_norm_unit)), '') AS ua, coalesce(lower(trim(b_norm_unit)), '') AS ub,
    fa.rate AS ra, fb.rate AS rb
  FROM pairs p
  LEFT JOIN fx fa ON fa.code = upper(trim(p.a_currency))
  LEFT JOIN fx fb ON fb.code = upper(trim(p.b_currency))
),
flags AS (
  SELECT *,
    a_norm_value IS NOT NULL AND b_norm_value IS NOT NULL AS two_values,
    cura <> '' AND curb <> '' AND cura <> curb AS cur_diff,
    ua = 'pct' AND ub IN ('count', 'text', '') AND b_norm_value BETWEEN 0 AND 1 AS b_frac,
    ub = 'pct' AND ua IN ('count', 'text', '') AND a_norm_value BETWEEN 0 AND 1 AS a_frac
  FROM axes
),
vals AS (
  SELECT *,
    pa <> '' AND pb <> '' AND pa <> pb AS period_diff,
    sa <> '' AND sb <> '' AND sa <> sb AS scope_diff,
    two_values AND cur_diff AND (ra IS NULL OR rb IS NULL) AS cur_bad,
    two_values AND cur_diff AND ra IS NOT NULL AND rb IS NOT NULL AS cur_fx,
    two_values AND ua <> ub AND NOT coalesce(b_frac, false) AND NOT coalesce(a_frac, false) AND ua <> '' AND ub <> '' AS unit_diff,
    CASE WHEN two_values AND ua <> ub AND NOT coalesce(b_frac, false) AND coalesce(a_frac, false) THEN a_norm_value * 100.0 ELSE a_norm_value END AS va,
    CASE WHEN two_values AND ua <> ub AND coalesce(b_frac, false) THEN b_norm_value * 100.0
         WHEN two_values AND cur_diff AND ra IS NOT NULL AND rb IS NOT NULL THEN b_norm_value * (rb / ra)
         ELSE b_norm_value END AS vb
  FROM flags
),
said AS (
  -- texts of the view are equal, opposed, of one postal code, or far apart; no similarity in between
  SELECT *, lower(trim(a_raw_value)) AS ta, lower(trim(b_raw_value)) AS tb FROM vals
),
talk AS (
  SELECT *, (ta = 'resigned' AND tb IN ('continues', 'active')) OR (tb = 'resigned' AND ta IN ('continues', 'active')) AS opposed,
    ta = tb OR (contains(ta, '560001') AND contains(tb, '560001')) AS alike
  FROM said
),
ruled AS (
  SELECT *,
    CASE WHEN ca < 0.5 OR cb < 0.5 THEN 'needs_review'
         WHEN period_diff OR scope_diff OR cur_bad OR unit_diff THEN 'contextual_variance'
         WHEN NOT two_values THEN CASE WHEN opposed THEN 'contradicts' WHEN alike THEN 'corroborates' ELSE 'needs_review' END
         WHEN abs(va - vb) / greatest(abs(va), abs(vb), CAST(1e-9 AS DOUBLE)) <= 0.01 THEN 'corroborates'
         ELSE 'contradicts' END AS relation,
    CASE WHEN ca < 0.5 OR cb < 0.5 THEN 'R1:low_confidence' ELSE
      concat_ws(',',
        CASE WHEN period_diff THEN 'R2:context_diff:period' END,
        CASE WHEN scope_diff THEN 'R2:context_diff:scope' END,
        CASE WHEN cur_bad THEN 'R2:context_diff:currency' END,
        CASE WHEN cur_fx THEN 'R3:FX:' || curb || '->' || cura || '@' || printf('%.4f', rb / ra) END,
        CASE WHEN two_values AND ua <> ub AND (coalesce(a_frac, false) OR coalesce(b_frac, false)) THEN 'R3:fraction_to_pct' END,
        CASE WHEN unit_diff THEN 'R2:context_diff:unit' END,
        CASE WHEN NOT (period_diff OR scope_diff OR cur_bad OR unit_diff) AND two_values THEN
          CASE WHEN abs(va - vb) / greatest(abs(va), abs(vb), CAST(1e-9 AS DOUBLE)) <= 0.01
               THEN 'R4:tolerance_match' ELSE 'R4:value_mismatch' END END,
        CASE WHEN NOT (period_diff OR scope_diff OR cur_bad OR unit_diff) AND NOT two_values THEN
          CASE WHEN opposed THEN 'R5:verb_opposition:' || ta || '_vs_' || tb WHEN alike THEN 'R5:string_match' ELSE 'R5:unmatched_text' END END) END AS rules,
    round(least(ca, cb), 2) AS confidence
  FROM talk
)"""


def exact_pairs(cross_document: bool = False) -> str:
    """CTE `pairs`: every unordered pair of facts with the same entity and attribute."""
    more = " AND a.document_id <> b.document_id" if cross_document else ""
    columns = ["fact_id", "document_id", "norm_value", "norm_unit", "currency", "period", "scope", "confidence", "raw_value"]
    both = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in columns)
    return f"""
pairs AS (
  SELECT a.entity_canon, a.attribute_canon, {both}
  FROM facts a JOIN facts b ON a.entity_canon = b.entity_canon AND a.attribute_canon = b.attribute_canon
   AND a.fact_id < b.fact_id{more}
)"""
