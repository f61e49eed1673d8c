"""Queries on retrieval, vectors, answers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import session
from factweave.catalog import views
from factweave.functions import text
from factweave.operators import pairs, reconcile, retrieval, semantic
from factweave.sources import facts as facts_of
from factweave.sources.tables import read_table
from factweave.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def _document_facts(spark, folder):
    """Documents as facts: the whole text is the quote."""
    d = read_table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("fact_id"), F.col("source").alias("entity"), F.col("lang").alias("attribute"), F.col("source").alias("entity_canon"),
        F.col("lang").alias("attribute_canon"), F.col("n_chars").cast("string").alias("raw_value"), F.col("text").alias("quote"),
        (F.col("doc_id") * 7 % 100 / 100.0).cast("double").alias("confidence"))


def keyword_search(spark, folder):
    return retrieval.keyword_search(_document_facts(spark, folder), ["that", "UND", "src3"], 50).select("fact_id", "entity", "attribute", "confidence")


QUERIES["keyword_search"] = keyword_search
ORACLES["keyword_search"] = """
SELECT doc_id AS fact_id, source AS entity, lang AS attribute, CAST(doc_id * 7 % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS confidence FROM documents
WHERE contains(lower(text), 'that') OR contains(lower(text), 'und') OR source = 'src3' OR contains(lower(source), 'src3') OR contains(lower(lang), 'und')
ORDER BY confidence DESC, doc_id LIMIT 50
"""


def row_text_filter(spark, folder):
    rows = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return retrieval.sort_rows(retrieval.text_filter(rows, "7"), "c_nationkey", descending=True)


QUERIES["row_text_filter"] = row_text_filter
ORACLES["row_text_filter"] = """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
WHERE contains(CAST(c_custkey AS VARCHAR), '7') OR contains(c_name, '7') OR contains(CAST(c_nationkey AS VARCHAR), '7')
"""


def recent_facts(spark, folder):
    o = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("document_id"), F.col("o_totalprice").alias("norm_value"),
        F.col("o_orderdate").alias("created_at"))
    return retrieval.search_facts(o, [0.0, 0.0], 50, document_id="2-HIGH").select("fact_id", "document_id", "norm_value", "similarity")


QUERIES["recent_facts"] = recent_facts
ORACLES["recent_facts"] = """
SELECT o_orderkey AS fact_id, o_orderpriority AS document_id, o_totalprice AS norm_value, CAST(1.0 AS DOUBLE) AS similarity FROM orders
WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50
"""


#: query vectors of one request
MOST_ASKED = 1000


def _exemplars(spark, folder):
    """The request: the first vector of each of the ten labels."""
    e = read_table(spark, folder, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))


def vector_topk(spark, folder):
    first = _exemplars(spark, folder).limit(MOST_ASKED + 1).collect()  # a request: one vector a label
    if len(first) > MOST_ASKED:
        raise ValueError(f"a request holds {MOST_ASKED} vectors at most")
    asked = {str(r["label"]): [float(x) for x in r["embedding"]] for r in first}
    rows = retrieval.vector_top_k(read_table(spark, folder, "embeddings"), asked, 5, "vec_id")
    return rows.select("query", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


QUERIES["vector_topk"] = vector_topk
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
EXEMPLAR_SQL = "ex AS (SELECT label, arg_min(embedding, vec_id) AS q, min(vec_id) AS ex_id FROM embeddings GROUP BY label)"
ORACLES["vector_topk"] = f"""
WITH {EXEMPLAR_SQL}, s AS (SELECT CAST(ex.label AS VARCHAR) AS query, vec_id, {_COS.format(a='embedding', b='q')} AS sim FROM embeddings CROSS JOIN ex),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""


def nearest_label(spark, folder):
    e = read_table(spark, folder, "embeddings")
    metrics = _exemplars(spark, folder).select(F.concat(F.lit("metric-"), F.col("label").cast("string")).alias("name"), "embedding")
    last = e.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("embedding"))
    namespace = last.select(F.concat(F.lit("legacy-"), F.col("label").cast("string")).alias("name"), "embedding")
    rows = semantic.nearest_names(e.select("vec_id", "embedding"), metrics, namespace, 0.25, "vec_id")
    return rows.select("vec_id", "name", F.round("similarity", 6).alias("similarity"))


QUERIES["nearest_label"] = nearest_label
ORACLES["nearest_label"] = f"""
WITH {EXEMPLAR_SQL}, la AS (SELECT label, arg_max(embedding, vec_id) AS q FROM embeddings GROUP BY label),
m AS (SELECT vec_id, 'metric-' || ex.label AS name, {_COS.format(a='embedding', b='q')} AS sim FROM embeddings CROSS JOIN ex),
l AS (SELECT vec_id, 'legacy-' || la.label AS name, {_COS.format(a='embedding', b='q')} AS sim FROM embeddings CROSS JOIN la),
bm AS (SELECT * FROM m WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1),
bl AS (SELECT * FROM l WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) = 1)
SELECT e.vec_id, coalesce(bm.name, bl.name) AS name, round(coalesce(bm.sim, bl.sim), 6) AS similarity
FROM embeddings e LEFT JOIN bm USING (vec_id) LEFT JOIN bl USING (vec_id)
"""


def semantic_pairs(spark, folder):
    rows = semantic.similar_pairs(read_table(spark, folder, "embeddings"), 0.40, "vec_id")
    return rows.select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


QUERIES["semantic_pairs"] = semantic_pairs
ORACLES["semantic_pairs"] = f"""
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS.format(a='a.embedding', b='b.embedding')} > 0.40
"""


def candidate_pairs_all(spark, folder):
    e = read_table(spark, folder, "embeddings")
    facts = e.select(F.col("vec_id").alias("fact_id"), F.col("label").alias("attribute_canon"), (F.col("vec_id") % 25).alias("entity_canon"), "embedding")
    exact = pairs.exact_candidates(facts.select("fact_id", "attribute_canon", "entity_canon"))
    return semantic.candidate_pairs(facts, exact, 0.40)


QUERIES["candidate_pairs_all"] = candidate_pairs_all
ORACLES["candidate_pairs_all"] = f"""
SELECT a.vec_id AS a_id, b.vec_id AS b_id, CASE WHEN a.label = b.label THEN 'exact' ELSE 'semantic' END AS source
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE (a.label = b.label AND a.vec_id % 25 = b.vec_id % 25) OR (a.label <> b.label AND {_COS.format(a='a.embedding', b='b.embedding')} > 0.40)
"""


def hybrid_retrieval(spark, folder):
    facts = _document_facts(spark, folder).join(
        read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding"), "fact_id", "left")
    asked = _exemplars(spark, folder).filter(F.col("label").isin(0, 1, 2))
    ex = {r["label"]: [float(x) for x in r["embedding"]] for r in asked.collect()}
    rows = retrieval.hybrid(facts, [("that thing", ex[0]), ("src2 que", ex[1]), ("qqqq", ex[2])])
    lines = retrieval.with_context_lines(rows.withColumns({"period": F.lit(None).cast("string"), "scope": F.lit(None).cast("string"),
                                                          "filename": F.lit("corpus"), "page": F.lit(0)}))
    return lines.select("number", "fact_id", F.sha2("context_line", 256).alias("context_sha"))


QUERIES["hybrid_retrieval"] = hybrid_retrieval


def _keyword_branch(position, tokens):
    test = " OR ".join(f"contains(lower({c}), '{t}')" for t in tokens for c in ("text", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    return f"SELECT {position} AS q, 1 AS s, row_number() OVER (ORDER BY doc_id * 7 % 100 DESC, doc_id) AS place, doc_id AS fact_id FROM documents WHERE {test} QUALIFY place <= 5"


def _vector_branch(position):
    return (f"SELECT {position} AS q, 0 AS s, row_number() OVER (ORDER BY {_COS.format(a='embedding', b='ex.q')} DESC, vec_id) AS place, vec_id AS fact_id "
            f"FROM embeddings JOIN documents ON doc_id = vec_id CROSS JOIN ex WHERE ex.label = {position} QUALIFY place <= 5")


ORACLES["hybrid_retrieval"] = f"""
WITH {EXEMPLAR_SQL},
hits AS ({" UNION ALL ".join([_vector_branch(0), _keyword_branch(0, ['that', 'thing']), _vector_branch(1), _keyword_branch(1, ['src2', 'que']), _vector_branch(2), _keyword_branch(2, ['qqqq'])])}),
f AS (SELECT fact_id, min((q, s, place)) AS seen FROM hits GROUP BY fact_id),
n AS (SELECT fact_id, row_number() OVER (ORDER BY seen) AS number FROM f)
SELECT CAST(number AS INTEGER) AS number, fact_id, sha256('[' || number || '] ' || source || ' ' || lang || ' = ' || n_chars || ' (N/A, N/A) — corpus p.1: "' || text || '"') AS context_sha
FROM n JOIN documents ON doc_id = fact_id WHERE number <= 30
"""


def embedding_texts(spark, folder):
    facts = facts_of.context_facts(spark, folder)
    line = text.embedding_text({c: F.col(c) for c in ["entity_canon", "attribute_canon", "raw_value", "period", "scope"]})
    return facts.select("fact_id", line.alias("line"))


QUERIES["embedding_texts"] = embedding_texts
ORACLES["embedding_texts"] = f"""
WITH {views.CONTEXT_FACTS}
SELECT fact_id, trim(entity_canon || ' ' || attribute_canon || ' ' || raw_value || ' ' || period || ' ' || coalesce(scope, '') || ' :: ') AS line FROM facts
"""


def citations_of_turns(spark, folder):
    """Every turn as an answer, keyed by (conv_id, turn), over the context of its conversation."""
    c = read_table(spark, folder, "conversations")
    answers = c.select("conv_id", "turn", F.concat(F.lit("Total [2] and [F1], again [2], unknown [77] — "), "text", F.lit(" [4]")).alias("answer"))
    context = c.select("conv_id", (F.col("turn") + 1).alias("number"), F.col("role").alias("quote"))
    return retrieval.citations(answers, context, ["conv_id", "turn"], "answer", ["conv_id"]).select("conv_id", "turn", "number", "quote")


QUERIES["citations_of_turns"] = citations_of_turns
ORACLES["citations_of_turns"] = """
SELECT a.conv_id, a.turn, c.turn + 1 AS number, c.role AS quote FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id
WHERE c.turn + 1 IN (1, 2, 4) OR contains(a.text, '[' || (c.turn + 1) || ']') OR contains(a.text, '[F' || (c.turn + 1) || ']')
"""


def citations(spark, folder):
    """All that the turns of a conversation cite of it."""
    return citations_of_turns(spark, folder).select("conv_id", "number", "quote").distinct()


QUERIES["citations"] = citations
ORACLES["citations"] = """
SELECT DISTINCT c.conv_id, c.turn + 1 AS number, c.role AS quote FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id
WHERE c.turn + 1 IN (1, 2, 4) OR contains(a.text, '[' || (c.turn + 1) || ']') OR contains(a.text, '[F' || (c.turn + 1) || ']')
"""


def _answers(spark, folder):
    c = read_table(spark, folder, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        F.concat("text", F.lit('\n```json:block {"type": "chart", "title": "T'), F.col("turn").cast("string"),
                 F.lit('"} ```\nthen ```json {"no": 1}``` and ```json {broken ``` end ```JSON {"type": "table"} ```')).alias("answer"))


def artifact_blocks(spark, folder):
    return retrieval.artifacts(_answers(spark, folder), "answer_id", "answer").select("answer_id", "type", "title")


QUERIES["artifact_blocks"] = artifact_blocks
ORACLES["artifact_blocks"] = """
SELECT conv_id || '-' || turn AS answer_id, 'chart' AS type, 'T' || turn AS title FROM conversations
UNION ALL SELECT conv_id || '-' || turn, 'table', NULL FROM conversations
"""


def clean_answers(spark, folder):
    return retrieval.clean_answers(_answers(spark, folder), "answer_id", "answer").select("answer_id", F.sha2("answer", 256).alias("answer_sha"))


QUERIES["clean_answers"] = clean_answers
ORACLES["clean_answers"] = """
SELECT conv_id || '-' || turn AS answer_id, sha256(regexp_replace(text || chr(10) || chr(10) || 'then ```json {"no": 1}``` and ```json {broken ``` end', '^\\s+|\\s+$', '', 'g')) AS answer_sha FROM conversations
"""


def history_tail(spark, folder):
    return retrieval.history_tail(read_table(spark, folder, "conversations")).select("conv_id", "turn", F.sha2("line", 256).alias("line_sha"))


QUERIES["history_tail"] = history_tail
ORACLES["history_tail"] = """
SELECT conv_id, turn, sha256(role || ': ' || text) AS line_sha FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4
"""


def _arriving(rows, order, parts, job):
    """Delivers a table to `job(stream, home)` in parts, by the order of one column (nulls come
    first), and returns what the job has after the last one. Each part is one batch."""
    spark, staged, path = rows.sparkSession, session.new_path(rows.sparkSession, "staged"), session.new_path(rows.sparkSession, "arriving")
    cuts = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001)
    place = F.expr("0") + sum((F.coalesce(F.col(order) > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    rows.withColumn("part", place).write.partitionBy("part").parquet(staged)
    found, home = None, session.new_path(spark, "home")
    for i in range(parts):
        spark.read.parquet(staged).filter(F.col("part") == i).select(*rows.columns).write.mode("append").parquet(path)
        found = job(jobs.file_stream(spark, path, rows.schema), home)
    return found


def stream_dedup(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return _arriving(docs, "doc_id", 3, lambda stream, home: jobs.deduplicated_intake(stream, "doc_id", "text", home))


QUERIES["stream_dedup"] = stream_dedup
ORACLES["stream_dedup"] = "SELECT min(doc_id) AS document_id, sha256(text) AS sha256 FROM documents GROUP BY sha256(text)"


#: milliseconds of 2000-01-01; a stream's first watermark is 1970, and what is not later than the watermark is dropped
FIRST_ARRIVAL = 946_684_800_000


def stream_dedup_watermark(spark, folder):
    """Documents as if one came every millisecond from 2000 on; copies up to two days apart are recognised."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", F.timestamp_millis(F.coalesce("doc_id", F.lit(0)) + F.lit(FIRST_ARRIVAL)).alias("at"))
    run = lambda stream, home: jobs.run_to_table(jobs.distinct_contents(stream, "text", "at", "2 days"), "contents", home)
    return _arriving(docs, "doc_id", 3, run).select("sha256")


QUERIES["stream_dedup_watermark"] = stream_dedup_watermark
ORACLES["stream_dedup_watermark"] = "SELECT DISTINCT sha256(text) AS sha256 FROM documents"


def stream_reconcile(spark, folder):
    facts = facts_of.context_facts(spark, folder).select(*reconcile.COMPARED, "entity_canon", "attribute_canon")
    arriving = session.new_path(spark, "arriving-facts")
    session.write_table(facts.repartition(3, "document_id", "fact_id"), arriving)
    stream = jobs.file_stream(spark, arriving, facts.schema, files_per_batch=1)
    rows = jobs.incremental_reconciliation(stream, ["entity_canon", "attribute_canon"])
    return rows.select("fact_a", "fact_b", "relation", F.array_join("rules_applied", ",").alias("rules"))


QUERIES["stream_reconcile"] = stream_reconcile
ORACLES["stream_reconcile"] = f"""
WITH {views.CONTEXT_FACTS}, {views.exact_pairs()}, {views.RULES}
SELECT a_fact_id AS fact_a, b_fact_id AS fact_b, relation, rules FROM ruled
"""


def stream_admission(spark, folder):
    events = read_table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").alias("at"), F.unix_micros("ts").alias("micros"))
    run = lambda stream, home: jobs.run_to_table(
        jobs.admission(stream.drop("micros"), limit=3, window_seconds=86400, lateness="1 day"), "admission", home)
    rows = _arriving(events, "micros", 3, run)
    return rows.select("key", "event_id", "admitted")


QUERIES["stream_admission"] = stream_admission
ORACLES["stream_admission"] = """
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, event_id, n, true AS admitted, [t] AS win FROM o WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.n, len(list_filter(r.win, lambda x: x > o.t - 86400000000)) < 3,
         CASE WHEN len(list_filter(r.win, lambda x: x > o.t - 86400000000)) < 3 THEN list_append(list_filter(r.win, lambda x: x > o.t - 86400000000), o.t)
              ELSE list_filter(r.win, lambda x: x > o.t - 86400000000) END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1
)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, admitted FROM r
"""
