"""Classes, pairs and lines of values travel under names of sixteen bytes."""

from pyspark.sql import functions as F

from factweave.operators import counting


def test_names_are_short_and_apart(spark):
    rows = spark.createDataFrame([("a" * 400, "1"), ("a" * 400, "2"), ("b", "1")], "long string, short string")
    first = rows.select(counting._name(F.col("long")).alias("n"), "short")
    names = [bytes(r[0]) for r in first.select(counting._name(F.col("n"), F.col("short"))).collect()]
    assert len(set(names)) == 3 and {len(n) for n in names} == {16}
