"""Statistical and arithmetic checks, for all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave import fixed_values as V
from factweave.functions.numbers import compact, first_digit
from factweave.operators.ordered import previous_row

GROUP = ["document_id", "entity_canon", "attribute_canon"]


def metric_key(attribute: Column) -> Column:
    """Metric names compare in lower case with underscores for spaces."""
    return F.regexp_replace(F.lower(attribute), r"\s+", "_")


def _stated(facts: DataFrame, *columns: str) -> DataFrame:
    test = F.col("norm_value").isNotNull()
    for c in columns:
        test = test & F.col(c).isNotNull() & (F.col(c) != "")
    return facts.filter(test)


def first_digit_check(facts: DataFrame, everything: bool = False) -> DataFrame:
    """Chi-squared of first digits per document; flagged documents only unless `everything`."""
    digit = first_digit(F.col("norm_value"))
    counts = facts.select("document_id", digit.alias("digit")).dropna().groupBy("document_id").agg(
        F.count(F.lit(1)).alias("sample_size"),
        *[F.count(F.when(F.col("digit") == d, 1)).alias(f"d{d}") for d in V.BENFORD_EXPECTED],
    )
    n = F.col("sample_size").cast("double")
    chi = F.lit(0.0)
    for d, share in V.BENFORD_EXPECTED.items():
        gap = F.col(f"d{d}") - F.lit(share) * n
        chi = chi + gap * gap / (F.lit(share) * n)
    deviation = F.array(
        *[F.struct((-F.abs(F.col(f"d{d}") / n - F.lit(share))).alias("dev"), F.lit(d).alias("digit"))
          for d, share in V.BENFORD_EXPECTED.items()]
    )
    worst = F.transform(F.slice(F.array_sort(deviation), 1, 3), lambda x: x["digit"])
    checked = counts.filter(F.col("sample_size") >= V.BENFORD_MIN_FACTS).select(
        "document_id", "sample_size", chi.alias("chi_squared"), worst.alias("worst_digits")
    )
    if not everything:
        checked = checked.filter(F.col("chi_squared") > V.BENFORD_FLAG)
    return checked.withColumn(
        "severity",
        F.when(F.col("chi_squared") > V.BENFORD_HIGH, "high").when(F.col("chi_squared") > V.BENFORD_FLAG, "medium"),
    )


def zscore_outliers(facts: DataFrame, threshold: float = V.ZSCORE_FLAG) -> DataFrame:
    """Facts far from the mean of their document, entity and attribute.

    Group statistics are an aggregation with partial sums, joined back; no group is sorted
    or buffered, and a hot group only skews a join that adaptive execution splits.
    """
    stated = _stated(facts, "entity_canon", "attribute_canon")
    stats = stated.groupBy(*GROUP).agg(
        F.avg("norm_value").alias("group_mean"),
        F.stddev_samp("norm_value").alias("group_stdev"),
        F.count(F.lit(1)).alias("group_size"),
    ).filter((F.col("group_size") >= V.ZSCORE_MIN_FACTS) & (F.col("group_stdev") >= V.SMALLEST_DENOMINATOR))
    scored = stated.join(stats, GROUP).withColumn(
        "z_score", F.abs(F.col("norm_value") - F.col("group_mean")) / F.col("group_stdev")
    )
    return scored.filter(F.col("z_score") > threshold).withColumn(
        "severity", F.when(F.col("z_score") > V.ZSCORE_HIGH, "high").otherwise("medium")
    )


def _with_previous(facts: DataFrame, group: list[str], segments: list[str], order: list[str]) -> DataFrame:
    stated = _stated(facts, "period").withColumn("_page", F.coalesce("page_number", F.lit(0)))
    carry = ["fact_id", "document_id", "period", "norm_value"]
    return previous_row(stated, group, segments, order, carry).drop("_page").filter(
        F.abs("previous.norm_value") >= V.SMALLEST_DENOMINATOR
    )


def period_swings(facts: DataFrame, swing_threshold: float = V.SWING_FLAG) -> DataFrame:
    """Changes of more than half between consecutive periods inside one document."""
    known = _stated(facts, "entity_canon", "attribute_canon")
    rows = _with_previous(known, GROUP, ["period"], ["period", "_page", "fact_id"])
    change = F.abs(F.col("norm_value") - F.col("previous.norm_value")) / F.abs("previous.norm_value")
    return rows.withColumn("change", change).filter(F.col("change") > swing_threshold).withColumn(
        "severity", F.when(F.col("change") > V.SWING_HIGH, "high").otherwise("medium")
    )


#: a shelf is a common start of document ids; starts are lengthened until there are so many shelves
SHELVES, START_LENGTHS = 256, (2, 4, 8, 12, 16, 24, 32, 64)


def _with_shelf(facts: DataFrame) -> DataFrame:
    """Adds `_shelf`: a start of document_id, as long as the ids at hand need to differ. Starts keep
    the order of the ids, so shelves can be segments of it."""
    counts = facts.agg(*[F.approx_count_distinct(F.substring("document_id", 1, n)) for n in START_LENGTHS]).first()
    length = next((n for n, found in zip(START_LENGTHS, counts) if found >= SHELVES), None)
    # fewer documents than shelves: the id itself
    return facts.withColumn("_shelf", F.col("document_id") if length is None else F.substring("document_id", 1, length))


def period_changes(facts: DataFrame, swing_threshold: float = V.SWING_FLAG) -> DataFrame:
    """Signed changes of more than half between consecutive facts of a metric in all documents."""
    known = facts.dropna(subset=["entity_canon", "attribute_canon"])
    known = _with_shelf(known)
    rows = _with_previous(
        known, ["entity_canon", "attribute_canon"], ["period", "_shelf", "document_id"], ["period", "document_id", "_page", "fact_id"]
    ).drop("_shelf")
    change = (F.col("norm_value") - F.col("previous.norm_value")) / F.abs("previous.norm_value")
    return (
        rows.withColumn("change", change)
        .filter(F.abs("change") > swing_threshold)
        .withColumn("direction", F.when(F.col("change") > 0, "increased").otherwise("decreased"))
        .withColumn("severity", F.when(F.abs("change") > V.SWING_HIGH, "critical").otherwise("high"))
    )


def cross_foot_check(facts: DataFrame, tolerance: float = V.TOLERANCE, everything: bool = False) -> DataFrame:
    """Line items that do not add up to their total, per document, entity and period.

    One aggregation picks the last fact of each metric name that a pattern mentions; the
    patterns are then plain columns of that row.
    """
    names = list(dict.fromkeys(n for items, total in V.CROSS_FOOT_PATTERNS for n in (*items, total)))
    rows = _stated(facts, "period").select(
        "document_id", F.coalesce("entity_canon", F.lit("")).alias("entity_canon"), "period", "norm_value", "fact_id",
        F.coalesce("page_number", F.lit(0)).alias("page"), metric_key(F.col("attribute_canon")).alias("metric"),
    ).filter(F.col("metric").isin(names))

    def last(name: str) -> Column:
        mine = F.col("metric") == name
        return F.max_by(
            F.when(mine, F.struct("norm_value", "fact_id")), F.when(mine, F.struct("page", "fact_id"))
        ).alias(name)

    wide = rows.groupBy("document_id", "entity_canon", "period").agg(*[last(n) for n in names])

    def result(items: tuple, total: str) -> Column:
        values = [F.col(f"{i}.norm_value") for i in items]
        computed = values[0]
        for v in values[1:]:
            computed = computed + v
        return F.struct(
            F.lit(total).alias("total_attribute"),
            F.lit(",".join(items)).alias("line_items"),
            F.col(f"{total}.fact_id").alias("fact_id"),
            F.col(f"{total}.norm_value").alias("reported_total"),
            computed.alias("computed_sum"),
            F.array(*[F.col(f"{i}.fact_id") for i in items]).alias("line_fact_ids"),
        )

    patterns = wide.select(
        "document_id", "entity_canon", "period", F.explode(F.array(*[result(*p) for p in V.CROSS_FOOT_PATTERNS])).alias("r")
    ).select("document_id", "entity_canon", "period", "r.*")
    complete = patterns.filter(
        F.col("computed_sum").isNotNull() & F.col("reported_total").isNotNull()
        & (F.abs("reported_total") >= V.SMALLEST_DENOMINATOR)
    ).withColumn("relative_diff", F.abs(F.col("computed_sum") - F.col("reported_total")) / F.abs("reported_total"))
    if not everything:
        complete = complete.filter(F.col("relative_diff") > tolerance)
    return complete.withColumn(
        "severity", F.when(F.col("relative_diff") > V.CROSS_FOOT_HIGH, "critical").otherwise("high")
    )


def run_checks(facts: DataFrame) -> DataFrame:
    """All four checks of all documents as one anomaly table."""
    none = F.lit(None).cast("string")
    percent = lambda x: F.concat(F.format_string("%.1f", x * 100), F.lit("%"))
    name = F.concat_ws(" ", "entity_canon", "attribute_canon")
    digits = first_digit_check(facts).select(
        none.alias("fact_id"), "document_id", F.lit("benford").alias("anomaly_type"), "severity",
        F.concat(F.lit("Benford's Law violation detected (χ²="), F.format_string("%.2f", F.col("chi_squared")),
                 F.lit(", p<0.05). Digits ["), F.array_join(F.col("worst_digits").cast("array<string>"), ", "),
                 F.lit("] deviate most from expected distribution.")).alias("description"),
        F.to_json(F.struct(F.round("chi_squared", 4).alias("chi_squared"), "sample_size", "worst_digits")).alias("details"),
    )
    outliers = zscore_outliers(facts).select(
        "fact_id", "document_id", F.lit("zscore").alias("anomaly_type"), "severity",
        F.concat(F.lit("Statistical outlier: "), name, F.lit(" (z-score="), F.format_string("%.2f", F.col("z_score")),
                 F.lit(")")).alias("description"),
        F.to_json(F.struct(F.round("z_score", 4).alias("z_score"), F.col("norm_value").alias("value"),
                           F.round("group_mean", 4).alias("group_mean"), F.round("group_stdev", 4).alias("group_stdev"),
                           "group_size")).alias("details"),
    )
    swings = period_swings(facts).select(
        "fact_id", "document_id", F.lit("period_swing").alias("anomaly_type"), "severity",
        F.concat(F.lit("Period-over-period swing: "), name, F.lit(" changed "), percent(F.col("change")), F.lit(" from "),
                 F.col("previous.period"), F.lit(" ("), compact(F.col("previous.norm_value")), F.lit(") to "), F.col("period"),
                 F.lit(" ("), compact(F.col("norm_value")), F.lit(")")).alias("description"),
        F.to_json(F.struct(F.round(F.col("change") * 100, 2).alias("pct_change"),
                           F.col("previous.period").alias("previous_period"),
                           F.col("previous.norm_value").alias("previous_value"),
                           F.col("period").alias("current_period"), F.col("norm_value").alias("current_value"),
                           F.col("previous.fact_id").alias("previous_fact_id"))).alias("details"),
    )
    footing = cross_foot_check(facts).select(
        "fact_id", "document_id", F.lit("cross_foot").alias("anomaly_type"), "severity",
        F.concat(F.lit("Cross-footing mismatch for "), F.coalesce(F.nullif("entity_canon", F.lit("")), F.lit("Entity")),
                 F.lit(" ("), F.col("period"), F.lit("): sum of "), F.regexp_replace("line_items", ",", ", "), F.lit(" is "),
                 compact(F.col("computed_sum")), F.lit(", but "), F.col("total_attribute"), F.lit(" is reported as "),
                 compact(F.col("reported_total")), F.lit(" (diff "), percent(F.col("relative_diff")), F.lit(")")).alias("description"),
        F.to_json(F.struct(F.round("computed_sum", 4).alias("computed_sum"), F.round("reported_total", 4).alias("reported_total"),
                           F.round(F.col("relative_diff") * 100, 2).alias("relative_diff_pct"), "total_attribute", "period",
                           "line_fact_ids")).alias("details"),
    )
    return digits.unionByName(outliers).unionByName(swings).unionByName(footing)


def as_findings(anomalies: DataFrame) -> DataFrame:
    """Anomalies in the shape of findings; a footing error is a computational error."""
    none = F.array().cast("array<string>")
    return anomalies.select(
        F.lit(None).cast("string").alias("case_id"),
        F.when(F.col("anomaly_type") == "cross_foot", "computational_error").otherwise("anomaly").alias("category"),
        "severity",
        F.concat(F.lit("Anomaly ("), F.col("anomaly_type"), F.lit("): "), F.substring("description", 1, 80)).alias("title"),
        "description",
        F.when(F.col("fact_id").isNotNull(), F.array("fact_id")).otherwise(none).alias("fact_ids"),
        F.array("document_id").alias("document_ids"),
        "details",
    )
