"""Reporting periods in their standard spelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import strip


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iU)" + pattern, group), F.lit(""))


def _full_year(year: Column) -> Column:
    return F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)


def normalized_period(period: Column, raw: Column | None = None) -> Column:
    """Quarter, half year, nine months, year ended, span, fiscal year, trailing or plain year."""
    given = F.coalesce(period, F.lit(""))
    text = strip(F.concat(given, F.lit(" "), F.coalesce(raw, F.lit("")) if raw is not None else F.lit("")))
    quarters = [
        F.concat(_full_year(_group(text, p, 2)), F.lit("-Q"), _group(text, p, 1)) for p in V.QUARTER_THEN_YEAR
    ]
    quarters.append(F.concat(_group(text, V.YEAR_THEN_QUARTER, 1), F.lit("-Q"), _group(text, V.YEAR_THEN_QUARTER, 2)))
    half = F.coalesce(_group(text, V.HALF_YEAR, 1), _group(text, V.HALF_YEAR, 2))
    span_end = _group(text, V.YEAR_SPAN, 2)
    century = F.substring(_group(text, V.YEAR_SPAN, 1), 1, 2)
    plain = _group(text, V.PLAIN_YEAR, 1)
    return F.when(
        text != "",
        F.coalesce(
            *quarters,
            F.concat(F.lit("H"), half, F.lit("-FY"), _full_year(_group(text, V.HALF_YEAR, 3))),
            F.concat(F.lit("9M-FY"), _full_year(_group(text, V.NINE_MONTHS, 1))),
            F.concat(F.lit("FY"), _group(text, V.YEAR_ENDED, 1)),
            F.concat(F.lit("FY"), F.when(F.length(span_end) == 2, F.concat(century, span_end)).otherwise(span_end)),
            F.concat(F.lit("FY"), _full_year(_group(text, V.FISCAL_YEAR, 1))),
            F.when(text.rlike("(?iU)" + V.TRAILING_TWELVE), F.concat_ws("-", F.lit("TTM"), plain)),
            plain,
            F.when(given != "", strip(given)),
        ),
    )
