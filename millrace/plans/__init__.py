"""Queries over the supplied tables, and the same in SQL."""

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import pricing_summary
from millrace.sources import table

SHIPPED_UNTIL = "2001-06-30"


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing_summary(table(spark, sf_dir, "lineitem"), SHIPPED_UNTIL)


PRICING_SQL = f"""
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 2) AS avg_qty,
       round(avg(l_extendedprice), 2) AS avg_price,
       round(avg(l_discount), 2) AS avg_disc,
       count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '{SHIPPED_UNTIL}'
GROUP BY l_returnflag, l_linestatus
"""

QUERIES = {"pricing_summary": pricing}
ORACLES = {"pricing_summary": PRICING_SQL}
