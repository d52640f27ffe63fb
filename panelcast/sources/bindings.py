"""The test tables seen as a monthly history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.schema import AMOUNT, HISTORY


# Customer columns that may serve as the first key, by size of the list they make.
FIRST_KEYS = {"segment": "c_mktsegment", "nation": "c_nationkey", "customer": "c_custkey"}


def bound_history(spark: SparkSession, sf_dir: str, first_key: str = "segment") -> DataFrame:
    """Line items as facts: segment, priority, status and flag are the business keys.

    Orders and customers are joined first, so that line items are shuffled once at most.
    Another ``first_key`` makes more series of the same facts.
    """
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.col(FIRST_KEYS[first_key]).cast("string").alias("bu")
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        "o_custkey",
        F.date_format("o_orderdate", "yyyy-MM").alias("periode"),
        F.col("o_orderpriority").alias("ctt"),
    )
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    discount = F.col("l_discount").cast("decimal(18,2)")
    share = F.lit("0.20").cast("decimal(18,2)")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        F.col("l_linestatus").alias("ope"),
        F.col("l_returnflag").alias("pthrough"),
        (price * (F.lit(1) - discount)).cast(AMOUNT).alias("ca"),
        (price * (share - discount)).cast(AMOUNT).alias("mg"),
    )
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(*HISTORY.names)
