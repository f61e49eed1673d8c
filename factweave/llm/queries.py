"""The registered queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from factweave.llm import (
    chat, decontaminate, exact_index, html_text, langid, merkle, mixing, packing, periodic, repeats, simhash, suffix_tree, syncmers)
from factweave.sources.tables import read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(read_table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(more), TOKENIZER))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, folder, "documents"))


def op4_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edit_report(read_table(spark, folder, "documents"))


def op5_recompression(spark: SparkSession, folder: str) -> DataFrame:
    kept = repeats.without_repeats(read_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(read_table(spark, folder, "documents"), TOKENIZER, keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_poisson_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_index.duplicate_report(read_table(spark, folder, "documents"))


def op9_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score_documents(read_table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = langid.fit(docs.filter(~held_out), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = langid.classify(docs, F.col("text"), F.struct("doc_id", held_out.alias("held_out")), model)
    return found.select("carried.doc_id", "carried.held_out", "lang_pred", "score")


def crc_of_id() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the texts repeats its words from some word on."""
    h, words = crc_of_id(), F.regexp_extract_all("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    placed = split.select("doc_id", "text", "words", F.size("words").alias("n"), "g").selectExpr(
        "doc_id", "text", "words", "cast(if(n > 0, g % n, 0) as int) as a", "cast(if(n > 0, 1 + (n - g % n) div (3 + g % 8), 1) as int) as p")
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    return placed.select("doc_id", F.coalesce(planted, "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(read_table(spark, folder, "documents")), F.col("text"), F.struct("doc_id"))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = found.select("*", periodic.longest_run(F.col("runs")).alias("best"))
    return best.select(
        "carried.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), F.col("text"), F.struct("doc_id"))
    hit = found.select("*", decontaminate.hit_words(F.col("spans")).alias("n_hit"))
    return hit.select(
        "carried.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    one_more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    changed = F.when(crc_of_id() % 7 == 0, merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), one_more, F.col("text")]))
    return merkle.manifest(docs, changed)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {q.__name__: q for q in (
    op1_main_text, op2_chat_format, op3_simhash, op4_syncmers, op5_recompression, op6_packing, op7_poisson_mixing, op8_exact_dedup, op9_suffix_tree,
    op10_language_id, op11_periodic_runs, op12_decontamination, op13_merkle_manifest, pipeline)}

ORACLES = {
    "op12_decontamination": """
WITH normal AS (
  SELECT doc_id, row_number() OVER () AS row_no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark),
placed AS (SELECT item, words, least(10, len(words)) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM item_words WHERE len(words) > 0),
patterns AS (SELECT DISTINCT item, size, array_to_string(words[k : k + size - 1], ' ') AS gram FROM placed),
sizes AS (SELECT DISTINCT size FROM patterns),
grams AS (
  SELECT row_no, size, k, array_to_string(words[k : k + size - 1], ' ') AS gram
  FROM (SELECT row_no, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM normal, sizes)),
hits AS (SELECT g.row_no, g.k, g.size, p.item FROM grams g JOIN patterns p ON g.size = p.size AND g.gram = p.gram),
hit_words AS (SELECT row_no, count(DISTINCT w) AS n_hit FROM (SELECT row_no, unnest(range(k, k + size)) AS w FROM hits) GROUP BY row_no),
hit_items AS (SELECT row_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row_no)
SELECT n.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM normal n LEFT JOIN hit_words w ON w.row_no = n.row_no LEFT JOIN hit_items i ON i.row_no = n.row_no""",
    "op13_merkle_manifest": """
WITH RECURSIVE field_rows AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n_old,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n_new,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda state, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda s, i: xor(s >> 1, (s & 1) * 3988292384), xor(state, b)), 4294967295), 4294967295) AS crc
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || n_old || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || n_new || tail) END AS changed FROM field_rows),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER () AS row_no FROM leaves),
nodes AS (
  SELECT coalesce('=' || lang, '') AS tree, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2),
subroots AS MATERIALIZED (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n,
    (SELECT max(level) FROM nodes m WHERE m.tree = o.tree) AS height
  FROM nodes o WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, place // 2),
ways AS MATERIALIZED (
  SELECT p.row_no, k.level, (p.place >> k.level) % 2 AS side, s.digest AS sibling
  FROM placed p JOIN subroots r ON r.tree = coalesce('=' || p.lang, '') CROSS JOIN range(0, 40) k(level)
  LEFT JOIN nodes s ON s.tree = r.tree AND s.level = k.level AND s.place = xor(p.place >> k.level, 1)
  WHERE k.level < r.height
  UNION ALL
  SELECT p.row_no, r.height + k.level, (r.place >> k.level) % 2, s.digest
  FROM placed p JOIN subroots r ON r.tree = coalesce('=' || p.lang, '') CROSS JOIN range(0, 40) k(level)
  LEFT JOIN tops s ON s.level = k.level AND s.place = xor(r.place >> k.level, 1)
  WHERE k.level < (SELECT max(level) FROM tops)),
folds AS (
  SELECT row_no, 0 AS level, coalesce(changed, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.row_no, f.level + 1, sha256(CASE WHEN side = 1 THEN coalesce(sibling, '') || digest ELSE digest || coalesce(sibling, '') END)
  FROM folds f JOIN ways w ON w.row_no = f.row_no AND w.level = f.level),
proofs AS (SELECT row_no, string_agg(sibling, '' ORDER BY level) AS siblings, count(*) AS height FROM ways GROUP BY row_no),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, r.subroot, root.root, sha256(coalesce(q.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = root.root AS verified
FROM placed p JOIN subroots r ON r.tree = coalesce('=' || p.lang, '') CROSS JOIN root LEFT JOIN proofs q ON q.row_no = p.row_no
JOIN folds f ON f.row_no = p.row_no AND f.level = coalesce(q.height, 0)""",
    "op7_poisson_mixing": """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS all_size, sum(sqrt(size)) AS all_roots FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN sqrt(size) / all_roots * all_size / size ELSE 0.0 END AS rate FROM sizes, totals),
steps(source, rate, k, log_p, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(CAST(k + 1 AS DOUBLE)), total + exp(log_p + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
  FROM steps WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 40)),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
    (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source
      AND s.total <= CAST('0x' || substr(md5('17:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0) AS n
  FROM documents d),
copies AS (SELECT *, unnest(range(n)) AS copy_no FROM counted)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no,
  CAST('0x' || substr(md5('17:' || doc_id || ':' || copy_no), 1, 13) AS BIGINT) / 4503599627370496.0 AS shuffle_key
FROM copies""",
    "op8_exact_dedup": """
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256
FROM rows""",
}
