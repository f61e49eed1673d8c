"""Hashes, table hints, heuristic claims and other text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip
from factweave.functions.similarity import partial_ratio


def content_hash(content: Column, page: Column, evidence_type: Column) -> Column:
    """Tamper seal of a piece of evidence; a missing page reads None."""
    return F.sha2(F.concat_ws("|", F.coalesce(content, F.lit("None")), F.coalesce(page.cast("string"), F.lit("None")), evidence_type), 256)


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(system, F.lit("|||"), user), 256)


def evidence_type(chunk_type: Column) -> Column:
    kinds = F.create_map(*[x for k, v in V.EVIDENCE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(kinds, F.coalesce(chunk_type, F.lit("paragraph"))), F.lit("paragraph"))


def table_hints(headers: Column, context: Column) -> Column:
    """struct(unit, currency, period) hinted at by table headers and the heading above."""
    text = F.concat_ws(" ", F.array_join(headers, " "), F.coalesce(context, F.lit("")))
    lowered = F.lower(text)

    def mentions(words: list[str]) -> Column:
        test = F.lit(False)
        for w in words:
            test = test | lowered.contains(w)
        return test

    currency = F.coalesce(*[F.when(mentions(words), F.lit(code)) for code, words in V.TABLE_CURRENCY_HINTS])
    unit = F.coalesce(
        *[F.when(lowered.rlike("(?U)" + pattern), F.lit(name)) for name, pattern in V.TABLE_UNIT_HINTS],
        F.when(text.contains("%") | lowered.contains("percent"), F.lit("pct")),
    )
    period = F.coalesce(
        *[F.nullif(F.replace(F.upper(F.regexp_extract(text, "(?iU)" + p, 1)), F.lit(" "), F.lit("")), F.lit("")) for p in V.TABLE_PERIOD_HINTS]
    )
    return F.struct(unit.alias("unit"), currency.alias("currency"), period.alias("period"))


def embedding_text(row_columns: dict[str, Column]) -> Column:
    """The line a fact is embedded as; canonical names win over stated ones."""
    get = lambda name: F.nullif(row_columns[name], F.lit("")) if name in row_columns else F.lit(None).cast("string")
    said = lambda *names: F.coalesce(*[get(n) for n in names], F.lit(""))
    head = F.concat(
        said("entity_canon", "entity"), F.lit(" "), said("attribute_canon", "attribute"), F.lit(" "), said("raw_value"), F.lit(" "),
        said("period"), F.lit(" "), said("scope"), F.lit(" :: "), said("quote"),
    )
    return strip(head)


def context_line(number: Column) -> Column:
    """The numbered line of a fact in a retrieval context; pages are shown from one."""
    has = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    page = F.coalesce((F.col("page") + 1).cast("string"), F.lit("?"))
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] "), has("entity_canon", "Unknown"), F.lit(" "), has("attribute_canon", "Value"),
        F.lit(" = "), has("raw_value", ""), F.lit(" ("), has("period", "N/A"), F.lit(", "), has("scope", "N/A"), F.lit(") — "),
        has("filename", "document"), F.lit(" p."), page, F.lit(': "'), has("quote", ""), F.lit('"'),
    )


def heuristic_facts(chunks: DataFrame) -> DataFrame:
    """Claims of the form "attribute was value" found line by line in chunk text.

    chunks: chunk_id, text, heading. One row per claim, in order of appearance.
    """
    period = F.nullif(
        F.upper(F.regexp_extract(F.concat_ws(" ", F.coalesce("heading", F.lit("")), "text"), "(?iU)" + V.HEURISTIC_PERIOD, 1)), F.lit("")
    )
    lines = chunks.select("chunk_id", period.alias("period"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kept = lines.withColumn("line", strip(F.col("line"))).filter(F.length("line") >= V.SHORTEST_LINE)
    pattern = F.lit("(?iU)" + V.HEURISTIC_CLAIM)
    claims = F.arrays_zip(
        F.regexp_extract_all("line", pattern, F.lit(1)).alias("attribute"),
        F.regexp_extract_all("line", pattern, F.lit(2)).alias("raw_value"),
    )
    rows = kept.select("chunk_id", "period", "line_no", "line", F.posexplode(claims).alias("claim_no", "c"))
    attribute, raw = strip(F.col("c.attribute")), strip(F.col("c.raw_value"))
    return rows.select(
        "chunk_id", "line_no", "claim_no", F.lit(V.HEURISTIC_ENTITY).alias("entity"), attribute.alias("attribute"),
        raw.alias("raw_value"), "period", F.substring("line", 1, V.QUOTE_CHARS).alias("quote"),
        F.lit(V.HEURISTIC_CONFIDENCE).alias("confidence"),
    ).filter((F.length("attribute") > 3) & F.col("raw_value").rlike("[0-9]"))


def verified_confidence(quote: Column, text: Column, confidence: Column) -> Column:
    """Confidence capped where the quote is not found in the text.

    Quotes that occur literally never leave the JVM: the similarity sees nulls for them.
    """
    q, t = F.lower(quote), F.lower(text)
    missing = ~t.contains(q)
    similarity = F.coalesce(partial_ratio(F.when(missing, q), F.when(missing, t), V.QUOTE_RATIO), F.lit(100.0))
    capped = F.round(F.least(confidence, F.lit(V.QUOTE_FALLBACK_CONFIDENCE)), 2)
    return F.when(similarity < V.QUOTE_RATIO, capped).otherwise(confidence)
