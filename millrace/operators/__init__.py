"""Operators on DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import charged, discounted


def pricing_summary(lineitem: DataFrame, shipped_until: str) -> DataFrame:
    """Quantities, prices and counts by return flag and line status, of lines shipped up to a day.

    One scan of seven columns with the date filter pushed down, aggregated before the only shuffle. Sums are rounded to cents because the order of summation of doubles is open.
    """
    cents = lambda column, name: F.round(column, 2).alias(name)
    return (
        lineitem.filter(F.col("l_shipdate") <= F.lit(shipped_until).cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            cents(F.sum("l_quantity"), "sum_qty"),
            cents(F.sum("l_extendedprice"), "sum_base_price"),
            cents(F.sum(discounted()), "sum_disc_price"),
            cents(F.sum(charged()), "sum_charge"),
            cents(F.avg("l_quantity"), "avg_qty"),
            cents(F.avg("l_extendedprice"), "avg_price"),
            cents(F.avg("l_discount"), "avg_disc"),
            F.count("*").alias("count_order"),
        )
    )
