"""The same operators over streams."""

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import pricing_summary


def pricing_summary_stream(spark: SparkSession, folder: str, shipped_until: str) -> DataFrame:
    """The pricing summary kept up to date as Parquet files of lines arrive in a folder; for output mode complete or update."""
    schema = spark.read.parquet(folder).schema
    return pricing_summary(spark.readStream.schema(schema).parquet(folder), shipped_until)
