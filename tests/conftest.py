import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
                                                    "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate column expressions over one list of inputs: values(expr_of_column, inputs, type)."""

    def run(expression, inputs, ddl="x string"):
        from pyspark.sql import functions as F

        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, " + ddl)
        return [r["r"] for r in df.withColumn("r", expression).orderBy("i").select("r").collect()]

    return run


FACT_DDL = ("fact_id string, document_id string, entity_canon string, attribute_canon string, raw_value string, norm_value double, "
            "norm_unit string, currency string, period string, scope string, confidence double, page_number int, chunk_id string, quote string")


@pytest.fixture
def make_facts(spark):
    """Facts from dicts; fields left out take a plain default."""

    def make(*rows):
        defaults = dict(document_id="d1", entity_canon="acme", attribute_canon="total_revenue", raw_value=None, norm_value=None,
                        norm_unit="currency", currency="USD", period="FY2024", scope="standalone", confidence=0.95, page_number=1,
                        chunk_id=None, quote=None)
        names = [part.split()[0] for part in FACT_DDL.split(", ")]
        data = []
        for i, row in enumerate(rows):
            full = {**defaults, "fact_id": f"f{i:03d}", **row}
            data.append(tuple(full[n] for n in names))
        return spark.createDataFrame(data, FACT_DDL)

    return make
