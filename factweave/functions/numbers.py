"""Number, unit, currency and magnitude expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V


# every character that counts as white space in Unicode
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def falsy_confidence(confidence: Column) -> Column:
    """A missing or zero confidence counts as full confidence."""
    return F.coalesce(F.nullif(confidence.cast("double"), F.lit(0.0)), F.lit(1.0))


def _currency(lowered: Column) -> Column:
    def mention(words: list[str]) -> Column:
        words_pattern = "|".join(re.escape(w) for w in words)
        return lowered.rlike(rf"(?U)(?:^|[\s\d\(])(?:{words_pattern})(?:[\s\d\)]|$)")

    return F.coalesce(*[F.when(mention(words), F.lit(code)) for code, words in V.CURRENCY_WORDS])


def _multiplier(lowered: Column) -> Column:
    branches = [
        F.when(lowered.rlike(r"(?U)" + "|".join(rf"\b{re.escape(w)}\b" for w in words)), F.lit(scale))
        for scale, words in V.MULTIPLIER_WORDS
    ]
    return F.coalesce(*branches, F.lit(1.0))


def with_number(df: DataFrame, raw: str, value: str | None = None, out: str = "number") -> DataFrame:
    """Adds struct `out` (norm_value, norm_unit, currency) read from the stated value `raw`.

    `value` names the column with the number already read by the extractor, if any; it is
    scaled only while it is smaller than a thousand. The steps are separate projections, so
    that no intermediate text is computed twice.
    """
    c = F.col
    given = c(value).cast("double") if value else F.lit(None).cast("double")
    text, lowered = c("_text"), c("_lowered")
    phrase = F.lit(False)
    for words in V.NEGATIVE_PHRASES:
        phrase = phrase | lowered.contains(words)
    found = F.regexp_replace(F.regexp_extract(text, "(?U)" + V.NUMBER, 0), ",", "").try_cast("double")
    staged = (
        df.withColumn("_text", strip(F.coalesce(raw, F.lit(""))))
        .withColumns({"_lowered": F.lower("_text"), "_given": given})
        .withColumns(
            {
                "_negative": text.rlike("(?U)" + V.PARENTHESISED_NUMBER) | text.startswith("-") | phrase,
                "_scale": _multiplier(lowered),
                "_found": found,
                "_currency": _currency(lowered),
            }
        )
        .withColumn(
            "_size",
            F.when(c("_given").isNull(), c("_found") * c("_scale"))
            .when((F.abs("_given") < V.SCALE_ONLY_BELOW) & (c("_scale") > 1.0), c("_given") * c("_scale"))
            .otherwise(c("_given")),
        )
        .withColumn("_number", F.when(c("_negative") & (c("_size") > 0), -c("_size")).otherwise(c("_size")))
    )
    unit = (
        F.when(lowered.rlike("(?U)" + V.BASIS_POINT_WORDS), "bps")
        .when(text.contains("%") | lowered.rlike("(?U)" + V.PERCENT_WORDS), "pct")
        .when(c("_currency").isNotNull(), "currency")
        .when(c("_number").isNotNull(), "count")
        .when(text.rlike("(?U)" + V.DATE), "date")
        .otherwise("text")
    )
    nothing = (F.coalesce(raw, F.lit("")) == "") & c("_given").isNull()
    result = F.when(~nothing, F.struct(c("_number").alias("norm_value"), unit.alias("norm_unit"), c("_currency").alias("currency")))
    return staged.withColumn(out, result).drop(
        "_text", "_lowered", "_given", "_negative", "_scale", "_found", "_currency", "_size", "_number"
    )


def first_digit(value: Column) -> Column:
    """Leading non-zero digit, null for zero."""
    digit = F.regexp_extract(F.abs(value).cast("string"), "[1-9]", 0)
    return F.when(value != 0, F.nullif(digit, F.lit("")).cast("int"))


def relative_delta(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(V.SMALLEST_DENOMINATOR))


def delta_severity(delta: Column) -> Column:
    return (
        F.when(delta > V.CRITICAL_DELTA, "critical")
        .when(delta > V.HIGH_DELTA, "high")
        .when(delta > V.MEDIUM_DELTA, "medium")
        .otherwise("low")
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(V.SEVERITIES, 1))):
        rank = F.when(severity == name, position).otherwise(rank)
    return rank


def compact(value: Column) -> Column:
    """Six significant digits without trailing zeros; scientific below 1e-4 and from 1e6."""
    sci = F.format_string("%.5e", value.cast("double"))
    mantissa = F.regexp_extract(sci, r"^(-?[0-9.]+)e", 1)
    exponent = F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

    plain = trimmed(sci.try_cast("decimal(30,12)").cast("string"))
    scientific = F.concat(trimmed(mantissa), F.regexp_extract(sci, r"(e[+-][0-9]+)$", 1))
    return F.when(value == 0, F.lit("0")).when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)


def safe_decimal(text: Column, precision: int = 38, scale: int = 10) -> Column:
    """A decimal, or null where the text is no number."""
    return text.try_cast(f"decimal({precision},{scale})")
