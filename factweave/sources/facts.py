"""Fact tables derived from the star schema, and the enriched fact scan.

Every view has the fact columns: fact_id, document_id, entity_canon, attribute_canon,
raw_value, norm_value, norm_unit, currency, period, scope, confidence, page_number, chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.session import write_through
from factweave.sources.tables import read_table

FACT_COLUMNS = [
    "fact_id", "document_id", "entity_canon", "attribute_canon", "raw_value", "norm_value",
    "norm_unit", "currency", "period", "scope", "confidence", "page_number", "chunk_id",
]


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def _order_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per (priority, customer, year): the unit that one document states facts about."""
    orders = read_table(spark, folder, "orders").select(
        "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"), _money("o_totalprice").alias("price")
    )
    sums = orders.groupBy("o_orderpriority", "o_custkey", "y").agg(
        F.sum("price").alias("total"), F.count(F.lit(1)).alias("n")
    )
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sums.join(customer, sums.o_custkey == customer.c_custkey).select(
        F.col("o_orderpriority").alias("document_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
        "c_custkey",
        F.col("c_name").alias("entity_canon"),
        "y",
        "total",
        "n",
        "c_acctbal",
    )


def _fact(attribute: str, raw: Column, value: Column, unit: Column, currency: Column) -> Column:
    return F.struct(
        F.lit(attribute).alias("attribute_canon"),
        raw.cast("string").alias("raw_value"),
        value.cast("double").alias("norm_value"),
        unit.cast("string").alias("norm_unit"),
        currency.cast("string").alias("currency"),
    )


def _spread(groups: DataFrame, facts: list[Column], scope: Column, confidence: Column) -> DataFrame:
    rows = groups.withColumn("fact", F.explode(F.array(*facts)))
    return rows.select(
        F.concat_ws("|", "document_id", F.col("c_custkey").cast("string"), F.col("y").cast("string"),
                    "fact.attribute_canon").alias("fact_id"),
        "document_id",
        "entity_canon",
        "fact.attribute_canon",
        "fact.raw_value",
        "fact.norm_value",
        "fact.norm_unit",
        "fact.currency",
        F.concat(F.lit("FY"), F.col("y").cast("string")).alias("period"),
        scope.alias("scope"),
        confidence.cast("double").alias("confidence"),
        F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 20 + 1).cast("int")).alias("page_number"),
        F.concat_ws("/", "document_id", (F.col("c_custkey") % 50).cast("string")).alias("chunk_id"),
    )


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue, order count and mean order value of each customer, year and priority."""
    g = _order_groups(spark, folder)
    total, n = F.col("total"), F.col("n")
    none = F.lit(None)
    return _spread(
        g,
        [
            _fact("total_revenue", total, total, F.lit("currency"), F.lit("USD")),
            _fact("order_count", n, n, F.lit("count"), none),
            _fact("average_order_value", F.concat_ws("/", total.cast("string"), n.cast("string")),
                  total.cast("double") / n.cast("double"), F.lit("currency"), F.lit("USD")),
        ],
        F.lit("standalone"),
        F.lit(0.9),
    )


def context_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Order facts with varying currency, unit, scope and confidence, and notes without a number,
    to exercise every rule."""
    g = _order_groups(spark, folder)
    p, ck, y, n = F.col("p"), F.col("c_custkey"), F.col("y"), F.col("n")
    currency = F.when(p == 3, "INR").when((p == 4) & (ck % 7 == 0), "XXX").otherwise("USD")
    revenue = F.when(p == 3, F.col("total").cast("double") / 0.012).otherwise(F.col("total").cast("double"))
    drift = 1.0 + ((ck + y + p) % 7) / 200.0
    balance = F.col("c_acctbal") * drift
    balance = F.when(p == 3, balance / 0.012).otherwise(balance)
    notes = F.array(*[F.lit(t) for t in ("resigned", "continues", "Active", "office 560001", "hq at 560001 west")])
    count = F.when(p == 5, F.least(n, F.lit(100)) / 100.0).otherwise(n.cast("double"))
    return _spread(
        g,
        [
            _fact("total_revenue", F.col("total"), revenue, F.lit("currency"), currency),
            _fact("account_balance", ck, balance, F.lit("currency"), currency),
            _fact("order_count", n, count, F.when(p == 5, "count").otherwise("pct"), F.lit(None)),
            _fact("status_note", F.element_at(notes, ((ck + p + y) % 5 + 1).cast("int")), F.lit(None), F.lit("text"), F.lit(None)),
        ],
        F.when(ck % 5 == 0, F.when(p == 2, "standalone").otherwise("consolidated")),
        F.when((p == 1) & ((ck + y) % 11 == 0), 0.4).when((ck + y) % 13 == 0, 0.0).otherwise(0.9),
    )


def status_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Balance-sheet style facts per customer and year from order status sums."""
    orders = read_table(spark, folder, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus", _money("o_totalprice").alias("price")
    )

    def by_status(status: str) -> Column:
        return F.sum(F.when(F.col("o_orderstatus") == status, F.col("price")))

    sums = orders.groupBy("o_custkey", "y").agg(
        by_status("F").alias("f"), by_status("O").alias("o"), by_status("P").alias("pend"), F.sum("price").alias("total")
    )
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    zero = F.lit(0).cast("decimal(18,2)")
    pending = F.coalesce("pend", zero)
    usd, unit = F.lit("USD"), F.lit("currency")
    g = sums.join(customer, sums.o_custkey == customer.c_custkey).select(
        F.concat(F.lit("statement-"), F.col("y").cast("string")).alias("document_id"),
        "c_custkey", F.col("c_name").alias("entity_canon"), "y", "f", "o", "total",
        pending.alias("pend"),
    )
    pairs = [
        ("current_assets", F.col("f")),
        ("non_current_assets", F.col("o")),
        ("total_assets", F.col("total")),
        ("total_liabilities", F.col("f")),
        ("total_equity", F.col("total") - F.col("f")),
        ("total_revenue", F.col("total")),
        ("net_income", F.col("f") - F.col("pend")),
        ("cost_of_goods_sold", F.col("pend")),
        ("total_debt", F.col("o")),
        ("current_liabilities", F.col("pend")),
    ]
    return _spread(g, [_fact(name, v, v, unit, usd) for name, v in pairs], F.lit(None).cast("string"), F.lit(0.9))


def metric_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Which core metric each document states per customer and year."""
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"), "o_totalprice"
    )
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name")
    names = F.array(*[F.lit(n) for n in ["total_revenue", "ebitda", "net_income", "total_assets", "headcount"]])
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("fact_id"),
        F.col("o_orderpriority").alias("document_id"),
        F.concat(F.col("o_orderpriority"), F.lit(".pdf")).alias("filename"),
        F.col("c_name").alias("entity_canon"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("attribute_canon"),
        F.concat(F.lit("FY"), F.col("y").cast("string")).alias("period"),
        F.col("o_totalprice").alias("norm_value"),
    )


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Event values as facts; one document per event type."""
    return read_table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("fact_id"),
        F.col("event_type").alias("document_id"),
        F.concat(F.col("event_type"), F.lit("-source")).alias("entity_canon"),
        F.lit("value").alias("attribute_canon"),
        F.col("value").alias("norm_value"),
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        F.lit(1).alias("page_number"),
    )


def balance_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Customer balances as facts; one document per market segment."""
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("fact_id"),
        F.col("c_mktsegment").alias("document_id"),
        F.col("c_name").alias("entity_canon"),
        F.lit("account_balance").alias("attribute_canon"),
        F.col("c_acctbal").alias("norm_value"),
    )


def line_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Unit prices of order lines: one document repeats the same metric of the same order."""
    li = read_table(spark, folder, "lineitem")
    return li.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in
                           ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]]).alias("fact_id"),
        F.concat(F.lit("ledger-"), (F.col("l_orderkey") % 100).cast("string")).alias("document_id"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("entity_canon"),
        F.lit("unit_price").alias("attribute_canon"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("norm_value"),
        F.concat(F.lit("FY"), F.year("l_shipdate").cast("string")).alias("period"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("scope"),
        F.col("l_linenumber").alias("page_number"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("raw_value"),
    )


def source_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents the order facts come from."""
    return (
        read_table(spark, folder, "orders")
        .select(F.col("o_orderpriority").alias("document_id"))
        .distinct()
        .withColumn("filename", F.concat("document_id", F.lit(".pdf")))
    )


def source_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The text blocks the order facts were found in."""
    return (
        read_table(spark, folder, "orders")
        .select(F.col("o_orderpriority").alias("document_id"), (F.col("o_custkey") % 50).alias("slot"))
        .distinct()
        .select(
            "document_id",
            F.concat_ws("/", "document_id", F.col("slot").cast("string")).alias("chunk_id"),
            (F.col("slot") + 1).cast("int").alias("page_number"),
        )
    )


def enrich(facts: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with the file name of their document and a page, the chunk's page if they name none."""
    pages = chunks.select("chunk_id", F.col("page_number").alias("chunk_page"))
    return (
        facts.join(documents.select("document_id", "filename"), "document_id")
        .join(pages, "chunk_id", "left")
        .withColumn("page", F.coalesce("page_number", "chunk_page"))
        .drop("chunk_page")
    )


def with_defaults(facts: DataFrame) -> DataFrame:
    """Defaults applied when facts are stored: confidence 1, status valid, texts never null."""
    columns = {
        "confidence": F.coalesce("confidence", F.lit(1.0)) if "confidence" in facts.columns else F.lit(1.0),
        "validation_status": F.coalesce("validation_status", F.lit("valid"))
        if "validation_status" in facts.columns else F.lit("valid"),
        "raw_value": F.coalesce("raw_value", F.lit("")) if "raw_value" in facts.columns else F.lit(""),
        "quote": F.coalesce("quote", F.lit("")) if "quote" in facts.columns else F.lit(""),
    }
    return facts.withColumns(columns)


def stored(facts: DataFrame, name: str = "facts") -> DataFrame:
    """The facts as a table of the shared folder, so that many readers share one derivation."""
    return write_through(facts, name)
