"""Queries on documents, evidence, chunks, layout and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import chunks, evidence, layout
from factweave.sources import html, intake
from factweave.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict = {}


def document_intake(spark, folder):
    d = read_table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 5 == 1, F.col("text"))
        .otherwise(F.concat(F.lit("%PDF-1.7\n"), "text")).alias("content"))
    rows = intake.accepted(d, limit=16 * 1024 * 1024)
    routed = rows.withColumn("route", intake.page_route(F.col("content")))
    return routed.select("doc_id", "size_bytes", "reject_reason", "sha256", "storage_key", "route")


QUERIES["document_intake"] = document_intake
ORACLES["document_intake"] = """
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text ELSE '%PDF-1.7' || chr(10) || text END AS c FROM documents),
v AS (SELECT *, octet_length(encode(c)) AS size_bytes,
  CASE WHEN c = '' THEN 'Uploaded file is empty' WHEN NOT starts_with(c, '%PDF') THEN 'Uploaded file is not a valid PDF document (missing %PDF header)'
       WHEN octet_length(encode(c)) > 16777216 THEN 'File exceeds maximum allowed size of 16MB' END AS reject_reason FROM t)
SELECT doc_id, CAST(size_bytes AS BIGINT) AS size_bytes, reject_reason, CASE WHEN reject_reason IS NULL THEN sha256(c) END AS sha256,
       CASE WHEN reject_reason IS NULL THEN 'docs/' || sha256(c) || '.pdf' END AS storage_key,
       CASE WHEN length(trim(c, ' ' || chr(9) || chr(10) || chr(13))) >= 40 THEN 'text' WHEN length(trim(c, ' ' || chr(9) || chr(10) || chr(13))) > 0 THEN 'scan' ELSE 'empty' END AS route
FROM v
"""


def document_dedup(spark, folder):
    d = read_table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return intake.with_original(d, "doc_id").select("doc_id", "sha256", "duplicate_of")


QUERIES["document_dedup"] = document_dedup
ORACLES["document_dedup"] = """
WITH t AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), f AS (SELECT sha256, min(doc_id) AS m FROM t GROUP BY sha256)
SELECT t.doc_id, t.sha256, CASE WHEN f.m <> t.doc_id THEN f.m END AS duplicate_of FROM t JOIN f USING (sha256)
"""


def _line_chunks(spark, folder):
    """Every line of every document as a chunk; ten lines make a page."""
    d = read_table(spark, folder, "documents")
    rows = chunks.lines(d.select("doc_id", "text"), "doc_id", "text")
    kind = F.when(F.col("line_no") % 7 == 3, "footnote").when(F.col("line_no") % 7 == 5, "ocr").otherwise("paragraph")
    return rows.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("document_id"), F.floor(F.col("line_no") / 10).cast("int").alias("page_number"), kind.alias("chunk_type"),
        F.col("line").alias("text"), F.col("line_no").alias("reading_order"), F.lit(None).cast("string").alias("heading"))


LINES_SQL = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
chunk AS (SELECT doc_id || '-' || line_no AS chunk_id, doc_id AS document_id, CAST(line_no // 10 AS INTEGER) AS page_number,
   CASE WHEN line_no % 7 = 3 THEN 'footnote' WHEN line_no % 7 = 5 THEN 'ocr' ELSE 'paragraph' END AS chunk_type, line AS text, line_no FROM ln),
cand AS (SELECT chunk_id, document_id, CASE WHEN page_number = 0 THEN 1 ELSE page_number END AS page,
   CASE chunk_type WHEN 'ocr' THEN 'ocr_text' ELSE chunk_type END AS evidence_type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM chunk),
sealed AS (SELECT *, sha256(content || '|' || page || '|' || evidence_type) AS content_hash FROM cand)"""


def evidence_dedup(spark, folder):
    found = evidence.distinct_evidence(evidence.chunk_evidence(_line_chunks(spark, folder)))
    return found.select("content_hash", "document_id", "page", "evidence_type", "copies")


QUERIES["evidence_dedup"] = evidence_dedup
ORACLES["evidence_dedup"] = f"""
WITH {LINES_SQL}
SELECT content_hash, min(document_id) AS document_id, min(page) AS page, min(evidence_type) AS evidence_type, count(*) AS copies FROM sealed GROUP BY content_hash
"""


def evidence_integrity(spark, folder):
    stored = evidence.distinct_evidence(evidence.chunk_evidence(_line_chunks(spark, folder)))
    touched = stored.withColumn("content", F.when(F.col("document_id") % 9 == 4, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return evidence.integrity(touched).groupBy("document_id", "intact").agg(F.count(F.lit(1)).alias("n"))


QUERIES["evidence_integrity"] = evidence_integrity
ORACLES["evidence_integrity"] = f"""
WITH {LINES_SQL}, e AS (SELECT content_hash, min(document_id) AS document_id FROM sealed GROUP BY content_hash)
SELECT document_id, document_id % 9 <> 4 AS intact, count(*) AS n FROM e GROUP BY ALL
"""


def evidence_chain(spark, folder):
    sealed = evidence.chunk_evidence(_line_chunks(spark, folder))
    facts = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.concat_ws("-", (F.col("o_custkey") % 1000).cast("string"), (F.col("o_orderkey") % 12).cast("string")).alias("chunk_id"))
    links = evidence.link_facts(facts, sealed)
    rows = evidence.evidence_chain(links, evidence.distinct_evidence(sealed))
    return rows.select("fact_id", "content_hash", "role", F.col("document_id").alias("evidence_document"), "page")


QUERIES["evidence_chain"] = evidence_chain
ORACLES["evidence_chain"] = f"""
WITH {LINES_SQL}, e AS (SELECT content_hash, min(document_id) AS document_id, min(page) AS page FROM sealed GROUP BY content_hash)
SELECT o.o_orderkey AS fact_id, s.content_hash, 'source' AS role, e.document_id AS evidence_document, e.page
FROM orders o JOIN sealed s ON s.chunk_id = (o_custkey % 1000) || '-' || (o_orderkey % 12) JOIN e USING (content_hash)
"""


def chunk_priority(spark, folder):
    rows = chunks.prioritised(_line_chunks(spark, folder))
    return rows.select("document_id", "chunk_id", "priority", "position")


QUERIES["chunk_priority"] = chunk_priority
PRIORITY_SQL = f"""{LINES_SQL},
c AS (SELECT chunk_id, document_id, line_no, chunk_type, text, CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 1 ELSE 2 END AS priority FROM chunk),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id, priority ORDER BY line_no) AS rn FROM c),
prio AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY priority, line_no) AS position FROM n WHERE priority < 2 OR rn <= 50)"""
ORACLES["chunk_priority"] = f"WITH {PRIORITY_SQL} SELECT document_id, chunk_id, priority, CAST(position AS INTEGER) AS position FROM prio"


def chunk_windows(spark, folder):
    rows = chunks.windows(chunks.prioritised(_line_chunks(spark, folder)))
    return rows.select("document_id", "window", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.sha2("prompt", 256).alias("prompt_sha"))


QUERIES["chunk_windows"] = chunk_windows
ORACLES["chunk_windows"] = f"""
WITH {PRIORITY_SQL}
SELECT document_id, CAST((position - 1) // 2 AS INTEGER) AS "window", string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids,
  sha256(string_agg('--- CHUNK ID: ' || chunk_id || ' | Type: ' || chunk_type || ' | Section: General ---' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'),
         chr(10) || chr(10) ORDER BY position)) AS prompt_sha
FROM prio GROUP BY document_id, (position - 1) // 2
"""


def extraction_routing(spark, folder):
    w = chunks.windows(chunks.prioritised(_line_chunks(spark, folder)))
    o = read_table(spark, folder, "orders")
    returned = o.select(
        F.col("o_orderkey").alias("fact_id"), (F.col("o_custkey") % 1000).alias("document_id"), (F.col("o_orderkey") % 4).cast("int").alias("window"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat_ws("-", (F.col("o_custkey") % 1000).cast("string"), (F.col("o_orderkey") % 6).cast("string"))).alias("chunk_id"))
    return chunks.route_facts(w, returned).select("fact_id", "document_id", "window", "chunk_id")


QUERIES["extraction_routing"] = extraction_routing
ORACLES["extraction_routing"] = f"""
WITH {PRIORITY_SQL},
w AS (SELECT document_id, CAST((position - 1) // 2 AS INTEGER) AS win, count(*) AS n, min(chunk_id) AS only_chunk FROM prio GROUP BY 1, 2),
r AS (SELECT o_orderkey AS fact_id, o_custkey % 1000 AS document_id, CAST(o_orderkey % 4 AS INTEGER) AS win,
             CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 1000) || '-' || (o_orderkey % 6) END AS chunk_id FROM orders)
SELECT r.fact_id, r.document_id, r.win AS "window", coalesce(p.chunk_id, w.only_chunk) AS chunk_id
FROM r JOIN w ON w.document_id = r.document_id AND w.win = r.win
LEFT JOIN prio p ON p.document_id = r.document_id AND (p.position - 1) // 2 = r.win AND p.chunk_id = r.chunk_id
WHERE p.chunk_id IS NOT NULL OR w.n = 1
"""


def page_budget(spark, folder):
    scans = read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("document_id"), (F.col("l_partkey") % 97).cast("int").alias("page_number")).distinct()
    return chunks.within_budget(scans).select("document_id", "page_number", "route")


QUERIES["page_budget"] = page_budget
ORACLES["page_budget"] = """
WITH s AS (SELECT DISTINCT l_suppkey AS document_id, CAST(l_partkey % 97 AS INTEGER) AS page_number FROM lineitem)
SELECT document_id, page_number, CASE WHEN row_number() OVER (PARTITION BY document_id ORDER BY page_number) > 60 THEN 'skipped' ELSE 'scan' END AS route FROM s
"""


def failed_pages(spark, folder):
    d = read_table(spark, folder, "documents")
    pages = d.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 9 + 1).cast("int").alias("page_number"))
    transcripts = d.filter(F.col("doc_id") % 4 != 1).select(
        F.col("doc_id").alias("document_id"), (F.col("doc_id") % 9 + 1).cast("int").alias("page_number"),
        F.when(F.col("doc_id") % 4 != 3, F.col("text")).alias("markdown"), F.lit("provider timed out").alias("error"))
    rows = chunks.transcribed_pages(pages, transcripts)
    return rows.select("document_id", "page_number", "route", "chunk_type", F.sha2("text", 256).alias("text_sha"), "heading")


QUERIES["failed_pages"] = failed_pages
ORACLES["failed_pages"] = """
SELECT doc_id AS document_id, CAST(doc_id % 9 + 1 AS INTEGER) AS page_number, CASE WHEN doc_id % 2 = 1 THEN 'failed' ELSE 'transcribed' END AS route,
  CASE WHEN doc_id % 2 = 1 THEN 'needs_review' ELSE 'ocr' END AS chunk_type,
  sha256(CASE WHEN doc_id % 2 = 1 THEN '[OCR Transcription Failed] Page ' || (doc_id % 9 + 1) || ' could not be transcribed' ||
     CASE WHEN doc_id % 4 = 3 THEN ': provider timed out' ELSE '' END ELSE text END) AS text_sha,
  CASE WHEN doc_id % 2 = 1 THEN 'OCR Failed' END AS heading
FROM documents
"""


def markdown_blocks(spark, folder):
    d = read_table(spark, folder, "documents")
    body = F.concat(F.lit("intro line\n# Report "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n\n| metric | value |\n| --- | --- |\n| chars | "),
                    F.col("n_chars").cast("string"), F.lit(" |\n\n"), "lang", F.lit(" closing\n## Notes\n"), "source")
    rows = chunks.markdown_blocks(d.select("doc_id", body.alias("body")), "doc_id", "body")
    return rows.select("doc_id", "reading_order", "chunk_type", F.sha2("text", 256).alias("text_sha"), "heading")


QUERIES["markdown_blocks"] = markdown_blocks
ORACLES["markdown_blocks"] = """
WITH d AS (SELECT doc_id, 'intro line' || chr(10) || '# Report ' || doc_id || chr(10) || text || chr(10) || chr(10) || '| metric | value |' || chr(10) ||
   '| --- | --- |' || chr(10) || '| chars | ' || n_chars || ' |' || chr(10) || chr(10) || lang || ' closing' || chr(10) || '## Notes' || chr(10) || source AS body FROM documents),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM d),
k AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM l),
k2 AS (SELECT *, CASE WHEN regexp_matches(t, '^#{1,6}\\s') THEN 'heading' WHEN t LIKE '|%|' OR t = '|' THEN 'table' WHEN t = '' THEN 'blank' ELSE 'text' END AS kind FROM k),
k3 AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'blank' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 'text') AS before FROM k2),
k4 AS (SELECT *, CASE WHEN kind = 'blank' THEN CASE WHEN before = 'heading' THEN 'text' ELSE before END ELSE kind END AS run FROM k3),
k5 AS (SELECT *, CASE WHEN kind = 'heading' OR run <> coalesce(lag(run) OVER (PARTITION BY doc_id ORDER BY n), '') THEN 1 ELSE 0 END AS st,
       last_value(CASE WHEN kind = 'heading' THEN regexp_replace(t, '^#{1,6}\\s+', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS heading FROM k4),
k6 AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM k5),
g AS (SELECT doc_id, b, run, heading, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS text FROM k6 GROUP BY doc_id, b, run, heading)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) AS INTEGER) AS reading_order, CASE WHEN run = 'text' THEN 'ocr_block' ELSE run END AS chunk_type,
       sha256(text) AS text_sha, heading FROM g WHERE text <> ''
"""


def _boxes(spark, folder):
    """Block boxes from order lines: an order is a document, each supplier group a page."""
    li = read_table(spark, folder, "lineitem")
    x0 = (F.col("l_partkey") % 500).cast("double")
    y0 = F.col("l_extendedprice").cast("decimal(18,2)").cast("double") % 700.0
    return li.select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"),
        F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("block_no"),
        x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 6).alias("x1"), (y0 + 12.0).alias("y1"), F.lit(600.0).alias("page_width"),
        F.col("l_discount"), F.col("l_returnflag"))


BOXES_SQL = """
box AS (SELECT l_orderkey AS document_id, 1 AS page_number, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS block_no,
  CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) % 700.0 AS y0,
  CAST(l_partkey % 500 AS DOUBLE) + l_quantity * 6 AS x1, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) % 700.0 + 12.0 AS y1, l_discount, l_returnflag FROM lineitem)"""


def reading_order(spark, folder):
    return layout.reading_order(_boxes(spark, folder)).select("document_id", "block_no", "reading_order")


QUERIES["reading_order"] = reading_order
ORACLES["reading_order"] = f"""
WITH {BOXES_SQL},
s AS (SELECT *, CASE WHEN x1 <= 325 THEN 'left' WHEN x0 >= 275 THEN 'right' ELSE 'span' END AS side FROM box),
p AS (SELECT *, count(CASE WHEN side = 'left' THEN 1 END) OVER w AS nl, count(CASE WHEN side = 'right' THEN 1 END) OVER w AS nr,
        min(CASE WHEN side <> 'span' THEN y0 END) OVER w AS top FROM s WINDOW w AS (PARTITION BY document_id)),
z AS (SELECT *, CASE WHEN nl >= 2 AND nr >= 2 THEN CASE side WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE CASE WHEN y0 < top THEN 0 ELSE 3 END END ELSE 0 END AS zone,
        CASE WHEN nl >= 2 AND nr >= 2 THEN y0 ELSE round_even(y0 / 6.0, 0) * 6.0 END AS y FROM p)
SELECT document_id, block_no, CAST(row_number() OVER (PARTITION BY document_id ORDER BY zone, y, x0, block_no) AS INTEGER) AS reading_order FROM z
"""


def table_overlap(spark, folder):
    boxes = _boxes(spark, folder)
    tables = boxes.filter(F.col("l_returnflag") == "R")
    return layout.outside_tables(boxes.filter(F.col("l_returnflag") != "R"), tables).select("document_id", "block_no")


QUERIES["table_overlap"] = table_overlap
ORACLES["table_overlap"] = f"""
WITH {BOXES_SQL}
SELECT document_id, block_no FROM box b WHERE l_returnflag <> 'R' AND NOT EXISTS (
  SELECT 1 FROM box t WHERE t.l_returnflag = 'R' AND t.document_id = b.document_id AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1)
"""


def block_classes(spark, folder):
    li = read_table(spark, folder, "lineitem")
    spans = li.select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") % 4).alias("block_no"),
        F.col("l_linenumber").alias("line_no"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("span_no"),
        F.concat(F.lit(" part "), F.col("l_partkey").cast("string")).alias("text"), (F.lit(8.0) + F.col("l_discount") * 60).alias("size"),
        (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_suppkey") % 700).cast("double").alias("y0"),
        (F.col("l_partkey") % 500 + 40).cast("double").alias("x1"), (F.col("l_suppkey") % 700 + 12).cast("double").alias("y1"))
    rows = layout.blocks_of_spans(spans).withColumn("reading_order", F.col("block_no"))
    return layout.with_heading(rows).select("document_id", "block_no", "text", "x0", "y0", "x1", "y1", "chunk_type", "level",
                                            F.round("median_size", 4).alias("median_size"), "document_order", "heading")


QUERIES["block_classes"] = block_classes
ORACLES["block_classes"] = """
WITH s AS (SELECT l_orderkey AS document_id, l_linenumber % 4 AS block_no, l_linenumber AS line_no, l_partkey || '/' || l_suppkey AS span_no,
   ' part ' || l_partkey AS text, CAST(8.0 AS DOUBLE) + l_discount * 60 AS size, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0,
   CAST(l_partkey % 500 + 40 AS DOUBLE) AS x1, CAST(l_suppkey % 700 + 12 AS DOUBLE) AS y1 FROM lineitem),
m AS (SELECT document_id, median(size) AS med, arg_min(size, (block_no, line_no, span_no)) AS first_size FROM s GROUP BY document_id),
b AS (SELECT s.document_id, block_no, med, first_size, bool_or(size > med * 1.2) AS big, bool_or(size < med * 0.85) AS small,
   min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM s JOIN m USING (document_id) GROUP BY ALL),
ln AS (SELECT document_id, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS line FROM s GROUP BY ALL),
tx AS (SELECT document_id, block_no, trim(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM ln GROUP BY ALL),
c AS (SELECT b.*, tx.text, CASE WHEN big THEN 'heading' WHEN small THEN 'footnote' ELSE 'paragraph' END AS chunk_type,
   CASE WHEN big THEN CASE WHEN med * 1.4 < first_size THEN 1 ELSE 2 END END AS level FROM b JOIN tx USING (document_id, block_no))
SELECT document_id, block_no, text, x0, y0, x1, y1, chunk_type, level, round(med, 4) AS median_size,
   CAST(row_number() OVER w AS INTEGER) AS document_order,
   last_value(CASE WHEN chunk_type = 'heading' THEN split_part(text, chr(10), 1) END IGNORE NULLS) OVER w AS heading
FROM c WINDOW w AS (PARTITION BY document_id ORDER BY block_no)
"""


def _tables(spark, folder):
    """A table per customer: its orders by year."""
    o = read_table(spark, folder, "orders").select(
        "o_custkey", F.year("o_orderdate").cast("string").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    years = o.groupBy("o_custkey", "y").agg(F.sum("v").cast("string").alias("total"))
    rows = F.array_sort(F.collect_list(F.array("y", "total"))).alias("rows")
    unit = F.when(F.col("o_custkey") % 3 == 0, "Revenue (₹ in crore)").when(F.col("o_custkey") % 3 == 1, "Sales, USD million").otherwise("Share in %")
    return years.groupBy("o_custkey").agg(rows).select(
        "o_custkey", F.array(F.lit("Year"), unit).alias("headers"), "rows",
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Results FY 20"), F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0"))).otherwise("Q2 FY2024 update").alias("title"))


TABLES_SQL = """
yr AS (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders GROUP BY 1, 2),
tab AS (SELECT o_custkey, CASE o_custkey % 3 WHEN 0 THEN 'Revenue (₹ in crore)' WHEN 1 THEN 'Sales, USD million' ELSE 'Share in %' END AS h2,
    string_agg('| ' || y || ' | ' || total || ' |', chr(10) ORDER BY y) AS body FROM yr GROUP BY 1)"""


def table_markdown(spark, folder):
    return _tables(spark, folder).select("o_custkey", layout.table_markdown(F.col("headers"), F.col("rows")).alias("markdown"))


QUERIES["table_markdown"] = table_markdown
ORACLES["table_markdown"] = f"""
WITH {TABLES_SQL} SELECT o_custkey, '| Year | ' || h2 || ' |' || chr(10) || '| --- | --- |' || chr(10) || body AS markdown FROM tab
"""


def table_cells(spark, folder):
    return layout.table_cells(_tables(spark, folder), ["o_custkey"])


QUERIES["table_cells"] = table_cells
ORACLES["table_cells"] = f"""
WITH {TABLES_SQL}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS INTEGER) AS r FROM yr)
SELECT o_custkey, 0 AS "row", 0 AS col, 'Year' AS header, 'Year' AS value FROM tab
UNION ALL SELECT o_custkey, 0, 1, h2, h2 FROM tab
UNION ALL SELECT o_custkey, r, 0, 'Year', y FROM n
UNION ALL SELECT n.o_custkey, r, 1, h2, total FROM n JOIN tab USING (o_custkey)
"""


def table_hints(spark, folder):
    return layout.with_hints(_tables(spark, folder)).select("o_custkey", "unit_hint", "currency_hint", "period_hint")


QUERIES["table_hints"] = table_hints
ORACLES["table_hints"] = """
SELECT DISTINCT o_custkey, CASE o_custkey % 3 WHEN 0 THEN 'crore' WHEN 1 THEN 'million' ELSE 'pct' END AS unit_hint,
  CASE o_custkey % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' END AS currency_hint,
  CASE WHEN o_custkey % 2 = 0 THEN 'FY20' || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') ELSE 'FY2024' END AS period_hint
FROM orders
"""


def structure_persist(spark, folder):
    li = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    page = (F.col("l_suppkey") % 3).cast("int")
    title = F.concat(F.lit("Section "), (F.col("l_partkey") % 3).cast("string"))
    place = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    base = li.select(F.col("l_orderkey").alias("document_id"), page.alias("page_number"), title.alias("title"), place.alias("place"), "l_linenumber")
    sections = base.filter(F.col("l_linenumber") % 2 == 0).select("document_id", "page_number", "title", F.concat(F.lit("s"), "place").alias("section_id"), F.col("place").alias("reading_order"))
    tables = base.groupBy("document_id", "page_number").agg(F.min("place").alias("m")).select(
        "document_id", "page_number", F.lit(0).alias("table_index"), F.concat(F.lit("t"), "m").alias("table_id"))
    found = base.select("document_id", "page_number", F.col("place").alias("chunk_id"), F.col("title").alias("heading"),
                        F.when(F.col("l_linenumber") % 3 == 0, F.lit(0)).alias("table_index"))
    return layout.structured_chunks(found, sections, tables).select("document_id", "page_number", "chunk_id", "section_id", "table_id")


QUERIES["structure_persist"] = structure_persist
ORACLES["structure_persist"] = """
WITH b AS (SELECT l_orderkey AS d, CAST(l_suppkey % 3 AS INTEGER) AS p, l_partkey % 3 AS ti, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS place, l_linenumber AS n FROM lineitem),
s AS (SELECT d, p, ti, 's' || max(place) AS section_id FROM b WHERE n % 2 = 0 GROUP BY ALL),
t AS (SELECT d, p, 't' || min(place) AS table_id FROM b GROUP BY ALL)
SELECT b.d AS document_id, b.p AS page_number, b.place AS chunk_id, s.section_id, CASE WHEN n % 3 = 0 THEN t.table_id END AS table_id
FROM b LEFT JOIN s USING (d, p, ti) LEFT JOIN t USING (d, p)
"""


def structure_counts(spark, folder):
    found = _line_chunks(spark, folder)
    pages = found.select("document_id", "page_number").distinct()
    return layout.structure_counts(pages, found.filter(F.col("reading_order") % 10 == 0), found.filter(F.col("reading_order") % 10 == 5), found)


QUERIES["structure_counts"] = structure_counts
ORACLES["structure_counts"] = f"""
WITH {LINES_SQL}
SELECT document_id, count(DISTINCT page_number) AS n_pages, count(CASE WHEN line_no % 10 = 0 THEN 1 END) AS n_sections,
       count(CASE WHEN line_no % 10 = 5 THEN 1 END) AS n_tables, count(*) AS n_chunks FROM chunk GROUP BY document_id
"""


def html_snippets(spark, folder):
    return html.anchors(read_table(spark, folder, "pages"), "page_id", "html", html.ANY_ANCHOR, limit=3)


QUERIES["html_snippets"] = html_snippets
ORACLES["html_snippets"] = """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1)[1:3]) AS url,
                  unnest(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2)[1:3]) AS snip,
                  generate_subscripts(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1)[1:3], 1) AS n FROM pages)
SELECT page_id, CAST(n - 1 AS INTEGER) AS position, url, regexp_replace(regexp_replace(snip, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS snippet FROM a
"""
