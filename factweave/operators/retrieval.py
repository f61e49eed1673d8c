"""Searching facts by keyword and by vector, and resolving what answers cite."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factweave import fixed_values as V
from factweave.functions.numbers import strip
from factweave.functions.text import context_line
from factweave.functions.vectors import cosine_to, usable
from factweave.operators.ordered import first_rows

KEYWORD_COLUMNS = ["entity", "attribute", "entity_canon", "attribute_canon", "raw_value", "quote"]


def select_facts(facts: DataFrame, document_id: str | None = None, entity_canon: str | None = None, attribute_canon: str | None = None) -> DataFrame:
    for name, value in [("document_id", document_id), ("entity_canon", entity_canon), ("attribute_canon", attribute_canon)]:
        if value:
            facts = facts.filter(F.col(name) == value)
    return facts


def search_facts(facts: DataFrame, query_vector: list[float] | None = None, limit: int = 50, vector: str = "embedding", id_column: str = "fact_id", **filters) -> DataFrame:
    """Most similar facts first; without a usable vector the newest first with similarity 1."""
    rows = select_facts(facts, **filters)
    if not usable(query_vector):
        return rows.withColumn("similarity", F.lit(1.0)).orderBy(F.desc("created_at"), id_column).limit(limit)
    scored = rows.withColumn("similarity", cosine_to(F.col(vector), query_vector)).filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), id_column).limit(limit)


def vector_top_k(facts: DataFrame, queries: dict[str, list[float]], k: int, id_column: str = "fact_id", vector: str = "embedding") -> DataFrame:
    """The k most similar facts of each query vector of a request, in one pass over the facts.

    Each task multiplies its batches with the query vectors and keeps k rows per query; only
    those are shuffled.
    """
    asked = {name: v for name, v in queries.items() if usable(v)}
    if not asked:
        raise ValueError("no usable query vector")
    names = list(asked)
    matrix = np.array([asked[n] for n in names], dtype="float64")
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack([np.asarray(v, dtype="float64") for v in batch["v"]])
            size = np.linalg.norm(m, axis=1)
            some = size > 0
            s = (m[some] / size[some, None]) @ matrix.T
            ids = batch["id"][some].to_numpy()
            parts = [pd.DataFrame({"id": pd.Series(list(ids), dtype=object), "query": n, "similarity": s[:, i]}) for i, n in enumerate(names)]
            merged = pd.concat([*parts] if kept is None else [kept, *parts])
            kept = merged.sort_values(["query", "similarity", "id"], ascending=[True, False, True]).groupby("query").head(k)
        if kept is not None:
            yield kept

    source = facts.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    schema = T.StructType([source.schema["id"], T.StructField("query", T.StringType()), T.StructField("similarity", T.DoubleType())])
    rows = source.mapInPandas(best, schema).withColumnRenamed("id", id_column)
    return first_rows(rows, ["query"], [F.desc("similarity"), F.col(id_column)], k, id_column)


def matches_any(tokens: list[str], columns: list[str]) -> Column:
    """Whether any token occurs in any column, in any case. Tokens are literal text."""
    test = F.lit(False)
    for token in tokens:
        for c in columns:
            test = test | F.coalesce(F.lower(c).contains(token.lower()), F.lit(False))
    return test


def keyword_search(facts: DataFrame, tokens: list[str], limit: int = 8, id_column: str = "fact_id") -> DataFrame:
    """Facts that contain any token, most confident first."""
    columns = [c for c in KEYWORD_COLUMNS if c in facts.columns]
    return facts.filter(matches_any(tokens, columns)).orderBy(F.desc("confidence"), id_column).limit(limit)


def text_filter(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the text anywhere in any column, in any case."""
    wanted = text.strip().lower()
    if not wanted:
        return rows
    shown = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    return rows.filter(F.exists(shown, lambda x: x.contains(wanted)))


def sort_rows(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Numbers by value, everything else as text."""
    numeric = dict(rows.dtypes)[column].startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint"))
    key = F.col(column) if numeric else F.coalesce(F.col(column).cast("string"), F.lit(""))
    return rows.orderBy(key.desc() if descending else key.asc())


def hybrid(facts: DataFrame, sub_queries: list[tuple[str, list[float]]], per_source: int = V.SUBQUERY_FACTS, limit: int = V.CONTEXT_FACTS) -> DataFrame:
    """Numbered context facts: per sub-query the vector hits, then the keyword hits, each fact once."""
    found = None
    for position, (text, vector) in enumerate(sub_queries):
        near = search_facts(facts, vector, per_source) if usable(vector) else None
        words = keyword_search(facts, text.split()[: V.SUBQUERY_TOKENS], per_source)
        parts = ([(0, near, F.desc("similarity"))] if near is not None else []) + [(1, words, F.desc("confidence"))]
        for source, hits, order in parts:
            top = hits.agg(F.sort_array(F.collect_list(F.struct((-F.col(order_name(source))).alias("o"), F.col("fact_id")))).alias("hits"))
            rows = top.select(F.posexplode("hits").alias("place", "h")).select(
                F.struct(F.lit(position).alias("q"), F.lit(source).alias("s"), "place").alias("seen"), F.col("h.fact_id").alias("fact_id"))
            found = rows if found is None else found.unionByName(rows)
    first = found.groupBy("fact_id").agg(F.min("seen").alias("seen")).orderBy("seen").limit(limit)
    ranked = first.agg(F.sort_array(F.collect_list(F.struct("seen", "fact_id"))).alias("all")).select(
        F.posexplode("all").alias("n", "f")).select((F.col("n") + 1).alias("number"), F.col("f.fact_id").alias("fact_id"))
    return ranked.join(facts, "fact_id")


def order_name(source: int) -> str:
    return "similarity" if source == 0 else "confidence"


def with_context_lines(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("context_line", context_line(F.col("number")))


def citations(answers: DataFrame, context: DataFrame, key: str | list[str], answer: str, within: list[str] | None = None) -> DataFrame:
    """Context facts an answer cites as [n] or [Fn]; the first mention counts, unknown numbers are ignored.
    `within` names those of the keys that the context has, if not all."""
    keys = [key] if isinstance(key, str) else key
    tokens = answers.select(*keys, F.posexplode(F.regexp_extract_all(answer, F.lit(V.CITATION), F.lit(1))).alias("position", "token"))
    first = tokens.groupBy(*keys, F.col("token").cast("bigint").alias("number")).agg(F.min("position").alias("position"))
    return first.join(context, [*(within or keys), "number"])


def artifacts(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, position, type, title, artifact) of fenced JSON objects that have a type."""
    return _fences(answers, key, answer).select(
        key, "position", F.try_variant_get("v", "$.type", "string").alias("type"),
        F.try_variant_get("v", "$.title", "string").alias("title"), F.to_json("v").alias("artifact"))


def _fences(answers: DataFrame, key: str, answer: str) -> DataFrame:
    found = F.arrays_zip(
        F.regexp_extract_all(answer, F.lit(V.ARTIFACT_FENCE), F.lit(0)).alias("whole"),
        F.regexp_extract_all(answer, F.lit(V.ARTIFACT_FENCE), F.lit(1)).alias("body"))
    rows = answers.select(key, F.posexplode(found).alias("position", "f")).withColumn("v", F.try_parse_json(strip(F.col("f.body"))))
    return rows.filter(F.schema_of_variant("v").startswith("OBJECT") & F.try_variant_get("v", "$.type", "variant").isNotNull())


def clean_answers(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """Answers without their artifacts."""
    cut = _fences(answers, key, answer).groupBy(key).agg(F.collect_list("f.whole").alias("_cut"))
    joined = answers.select(key, answer).join(cut, key, "left")
    cleaned = F.aggregate(F.coalesce("_cut", F.array().cast("array<string>")), F.col(answer), lambda text, part: F.replace(text, part, F.lit("")))
    return joined.select(key, strip(cleaned).alias(answer))


def history_tail(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", n: int = V.HISTORY_TURNS) -> DataFrame:
    """The last n messages of each conversation as "role: text"."""
    tail = first_rows(turns, [conversation], [F.desc(order)], n, order)
    return tail.select(conversation, order, F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
