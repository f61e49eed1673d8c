"""Decimal calculations over facts: ratios, growth, cross-footing, formulas and replay.

A request table names the input facts by id; values come from the fact table by equi join.
Every result row has calc_id, formula_id, formula, inputs, result, result_unit, is_verified, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V

#: sums are added up in this type; quotients in ALIGNED after both sides took the same power of ten
SUMMED, ALIGNED, RESULT = "decimal(38,18)", "decimal(27,18)", "decimal(38,4)"


def _values(facts: DataFrame, id_name: str, value_name: str) -> DataFrame:
    return facts.select(F.col("fact_id").alias(id_name), F.col("norm_value").alias(value_name))


def _aligned(a: Column, b: Column) -> tuple[Column, Column]:
    """Both values as decimals, exact in their written digits, times one power of ten that brings
    the larger one to nine places before the point. A quotient does not depend on that power, so
    no value is too small or too large; only one that is 10^27 times smaller than the other is."""
    largest = F.greatest(F.abs(a.cast("double")), F.abs(b.cast("double")))
    shift = F.when(largest > 0, F.lit(8) - F.floor(F.log10(largest))).otherwise(F.lit(0)).cast("int")

    def moved(value: Column) -> Column:
        parts = F.split(value.cast("string"), "E")
        exponent = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0)) + shift
        return F.concat(F.element_at(parts, 1), F.lit("E"), exponent.cast("string")).try_cast(ALIGNED)

    return moved(a), moved(b)


def _formula_text(name: Column) -> Column:
    known = F.create_map(*[x for k, v in V.FORMULAS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, name), name)


def _scaled_ratio(numerator: Column, denominator: Column, percent: Column) -> Column:
    """Four places, half up; percentages are the rounded ratio times 100."""
    ratio = F.round(F.try_divide(*_aligned(numerator, denominator)), 4)
    return F.when(percent, (ratio * 100).cast(RESULT)).otherwise(ratio.cast(RESULT))


def _growth(current: Column, previous: Column) -> Column:
    now, before = _aligned(current, previous)
    return F.round(F.try_divide(now - before, F.abs(before)) * 100, 2).cast(RESULT)


def _input(id_column: str, label: str, value_column: str) -> Column:
    return F.struct(
        F.col(id_column).alias("fact_id"), F.lit(label).alias("label"), F.col(value_column).cast("string").alias("value")
    )


def calculate_ratio(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests: calc_id, formula_name, numerator_id, denominator_id."""
    rows = requests.join(_values(facts, "numerator_id", "num"), "numerator_id", "left").join(
        _values(facts, "denominator_id", "den"), "denominator_id", "left"
    )
    percent = F.col("formula_name").isin(V.PERCENT_FORMULAS)
    result = _scaled_ratio(F.col("num"), F.col("den"), percent)
    error = (F.when(F.col("num").isNull() | F.col("den").isNull(), V.ERROR_MISSING).when(F.col("den") == 0, V.ERROR_DIVISION)
             .when(result.isNull(), V.ERROR_RANGE))
    return rows.select(
        "calc_id",
        F.lit("ratio").alias("formula_id"),
        "formula_name",
        _formula_text(F.col("formula_name")).alias("formula"),
        F.array(_input("numerator_id", "numerator", "num"), _input("denominator_id", "denominator", "den")).alias("inputs"),
        F.when(F.col("den") != 0, result).alias("result"),
        F.when(error.isNull(), F.when(percent, "pct").otherwise("ratio")).alias("result_unit"),
        F.lit(False).alias("is_verified"),
        error.alias("error"),
    )


def calculate_growth(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests: calc_id, current_id, previous_id."""
    rows = requests.join(_values(facts, "current_id", "cur"), "current_id", "left").join(
        _values(facts, "previous_id", "prev"), "previous_id", "left"
    )
    result = _growth(F.col("cur"), F.col("prev"))
    error = (F.when(F.col("cur").isNull() | F.col("prev").isNull(), V.ERROR_MISSING).when(F.col("prev") == 0, V.ERROR_INFINITE)
             .when(result.isNull(), V.ERROR_RANGE))
    return rows.select(
        "calc_id",
        F.lit("growth").alias("formula_id"),
        F.lit("yoy_growth").alias("formula_name"),
        F.lit(V.FORMULAS["yoy_growth"]).alias("formula"),
        F.array(_input("current_id", "current", "cur"), _input("previous_id", "previous", "prev")).alias("inputs"),
        F.when(F.col("prev") != 0, result).alias("result"),
        F.when(error.isNull(), F.lit("pct")).alias("result_unit"),
        F.lit(False).alias("is_verified"),
        error.alias("error"),
    )


def cross_foot(requests: DataFrame, facts: DataFrame, tolerance: float = V.TOLERANCE) -> DataFrame:
    """requests: calc_id, line_item_ids (array), total_id. Missing line items are left out of the sum."""
    items = requests.select("calc_id", "total_id", F.explode("line_item_ids").alias("item_id"))
    summed = (
        items.join(_values(facts, "item_id", "item"), "item_id", "left")
        .groupBy("calc_id", "total_id")
        .agg(F.try_sum(F.col("item").try_cast(SUMMED)).alias("computed"), F.count("item").alias("stated"), F.count(F.col("item").try_cast(SUMMED)).alias("usable"), F.array_sort(F.collect_list(F.struct(
            F.col("item_id").alias("fact_id"), F.lit("line_item").alias("label"), F.col("item").cast("string").alias("value")
        ))).alias("items"))
    )
    rows = summed.join(_values(facts, "total_id", "total").withColumnRenamed("total", "expected"), "total_id", "left")
    rows = rows.withColumns({"given": F.col("expected"), "expected": F.col("expected").try_cast(SUMMED)})
    missing = (F.col("stated") == 0) | F.col("given").isNull()
    beyond = ~missing & ((F.col("usable") < F.col("stated")) | F.col("computed").isNull() | F.col("expected").isNull())
    diff = F.abs(F.col("computed") - F.col("expected")).cast("double") / F.greatest(
        F.abs("expected").cast("double"), F.lit(V.SMALLEST_DENOMINATOR)
    )
    verified = ~missing & ~beyond & (diff <= tolerance)
    return rows.select(
        "calc_id",
        F.lit("cross_foot").alias("formula_id"),
        F.lit("cross_foot").alias("formula_name"),
        F.lit("cross_foot: " + V.FORMULAS["cross_foot"]).alias("formula"),
        F.concat("items", F.array(_input("total_id", "expected_total", "given"))).alias("inputs"),
        F.when(~missing & ~beyond, F.col("computed").try_cast(RESULT)).alias("result"),
        F.lit(None).cast("string").alias("result_unit"),
        F.coalesce(verified, F.lit(False)).alias("is_verified"),
        F.when(missing, F.lit(V.ERROR_MISSING))
        .when(beyond, F.lit(V.ERROR_RANGE))
        .when(~verified, F.concat(F.lit("Mismatch: computed "), _plain("computed"), F.lit(" vs expected "), _plain("expected"), F.lit(" (diff "), F.format_string("%.2f", diff * 100), F.lit("%)")))
        .alias("error"),
    )


def _plain(name: str) -> Column:
    """A decimal without the zeros at its end."""
    return F.regexp_replace(F.col(name).cast("string"), r"\.?0+$", "")


def evaluate_formulas(facts: DataFrame, formulas: dict[str, str] | None = None) -> DataFrame:
    """Every quotient formula of the catalogue for each document, entity and period.

    `formulas` maps a name to "numerator / denominator" over metric names; callers may add
    their own.
    """
    from factweave.operators.anomalies import metric_key

    chosen = formulas or {k: v for k, v in V.FORMULAS.items() if k not in ("yoy_growth", "cross_foot")}
    words = {w for text in chosen.values() for w in text.replace("(", " ").replace(")", " ").split() if w[0].isalpha()}
    keyed = facts.withColumn("_metric", metric_key(F.col("attribute_canon"))).filter(F.col("_metric").isin(sorted(words)))
    wide = keyed.groupBy("document_id", "entity_canon", "period").agg(
        *[F.max(F.when(F.col("_metric") == w, F.col("norm_value").try_cast(SUMMED))).alias(w) for w in sorted(words)]
    )

    def one(name: str, text: str) -> Column:
        top, bottom = text.rsplit(" / ", 1)
        num, den = F.expr(top), F.expr(bottom)
        percent = F.lit(name in V.PERCENT_FORMULAS)
        result = _scaled_ratio(num, den, percent)
        return F.struct(
            F.lit(name).alias("formula_name"),
            F.when(den != 0, result).alias("result"),
            F.lit("pct" if name in V.PERCENT_FORMULAS else "ratio").alias("result_unit"),
            F.when(num.isNull() | den.isNull(), V.ERROR_MISSING).when(den == 0, V.ERROR_DIVISION).when(result.isNull(), V.ERROR_RANGE).alias("error"),
        )

    return wide.select(
        "document_id", "entity_canon", "period", F.explode(F.array(*[one(*f) for f in chosen.items()])).alias("r")
    ).select("document_id", "entity_canon", "period", "r.*")


def verify(calculations: DataFrame, facts: DataFrame) -> DataFrame:
    """Re-executes stored calculations on today's facts. A calculation stored with an error verifies."""
    inputs = calculations.select("calc_id", "formula_id", "formula_name", "result", F.explode("inputs").alias("i")).select(
        "calc_id", "formula_id", "formula_name", "result", F.col("i.fact_id").alias("fact_id"), F.col("i.label").alias("label")
    )
    valued = inputs.join(_values(facts, "fact_id", "v"), "fact_id", "left")
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("v"))).alias(label)
    wide = valued.groupBy("calc_id", "formula_id", "formula_name", "result").agg(
        F.try_sum(F.when(F.col("label") == "line_item", F.col("v").try_cast(SUMMED))).alias("line_items"),
        pick("numerator"), pick("denominator"), pick("current"), pick("previous"),
    )
    percent = F.col("formula_name").isin(V.PERCENT_FORMULAS)
    again = (
        F.when(F.col("formula_id") == "cross_foot", F.col("line_items").try_cast(RESULT))
        .when(F.col("formula_id") == "growth", _growth(F.col("current"), F.col("previous")))
        .otherwise(_scaled_ratio(F.col("numerator"), F.col("denominator"), percent))
    )
    same = F.abs(again - F.col("result")) < F.lit(V.REPLAY_TOLERANCE).cast("decimal(10,4)")
    return wide.select(
        "calc_id", "formula_id", "result", again.alias("recomputed"),
        F.when(F.col("result").isNull(), F.lit(True)).otherwise(F.coalesce(same, F.lit(False))).alias("verified"),
    )


def calculations_of_fact(calculations: DataFrame, fact_id: str) -> DataFrame:
    """Calculations in which a fact takes part."""
    return calculations.filter(F.exists("inputs", lambda i: i["fact_id"] == fact_id)).orderBy("calc_id")
