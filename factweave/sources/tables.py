"""Reading the star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; zone-less timestamps become session-zone timestamps."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    for column in zoneless:
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df
