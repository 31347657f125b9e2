"""Tables as DataFrames."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data set; filters and column choices reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
