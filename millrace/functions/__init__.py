"""Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def discounted(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return F.col(price) * (1 - F.col(discount))


def charged(price: str = "l_extendedprice", discount: str = "l_discount", tax: str = "l_tax") -> Column:
    return discounted(price, discount) * (1 + F.col(tax))
