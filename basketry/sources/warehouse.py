"""Adapter from the star-schema tables (``part``, ``customer``, ``orders``,
``lineitem``, ``events``) to the canonical retail frames.

Mapping (one purchase = one line item of an order):

  purchases  customer_id = o_custkey, item_id = l_partkey,
             purchase_date = o_orderdate (day), quantity = l_quantity,
             total_price = l_extendedprice as decimal(18,2),
             employee_id = Emp01..Emp10 from l_suppkey on odd line numbers,
             NULL otherwise (so the employee fill has work)
  items      item_id = p_partkey, item_name = p_name,
             item_category = Service for p_type ECONOMY/STANDARD/MEDIUM else Product,
             item_subcategory = p_brand, unit_price = p_retailprice
  customers  age NULL when c_custkey % 17 = 0 else 18 + c_custkey % 58,
             gender NULL when c_custkey % 23 = 0 else F (even) / M (odd),
             segment = c_mktsegment, zip = c_nationkey,
             email = c_acctbal > 0, sms = c_custkey % 3 = 0,
             registration_date = 1994-01-01 + c_custkey % 730 days

Ids stay ``bigint``: joins and shuffles on longs are cheaper than on strings.
Each function returns a lazy frame; Catalyst prunes the scans to the columns a
query actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter.
SERVICE_TYPES = ("ECONOMY", "STANDARD", "MEDIUM")
REFERENCE_DATE = "2001-12-31"   # one day after the year of the last order date
EPOCH = "1995-01-01"           # first order date


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.when(F.col("p_type").isin(*SERVICE_TYPES), F.lit("Service"))
        .otherwise(F.lit("Product")).alias("item_category"),
        F.col("p_brand").alias("item_subcategory"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("customer_id"),
        F.when(k % 17 == 0, F.lit(None)).otherwise((k % 58 + 18).cast("int"))
        .cast("int").alias("age"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 2 == 0, F.lit("F"))
        .otherwise(F.lit("M")).alias("gender"),
        F.date_add(F.lit("1994-01-01").cast("date"), (k % 730).cast("int"))
        .alias("registration_date"),
        F.col("c_nationkey").cast("string").alias("zip_code"),
        (F.col("c_acctbal") > 0).alias("email_subscription"),
        (k % 3 == 0).alias("sms_subscription"),
        F.col("c_mktsegment").alias("segment"),
    )


def purchase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase columns that need no order (customer and date left out):
    item-only lists read the line items alone."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_price"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as purchases."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("o_orderdate").cast("date").alias("purchase_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_price"),
        F.when(F.col("l_linenumber") % 2 == 1,
               F.concat(F.lit("Emp"),
                        F.lpad((F.col("l_suppkey") % 10 + 1).cast("string"), 2, "0")))
        .alias("employee_id"),
    )


def event_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second purchase source: ``purchase`` events (user, day, value, item key
    from the ``k`` field of ``props``)."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("customer_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.lit(1).alias("quantity"),
        F.col("ts").cast("date").alias("purchase_date"),
        F.col("value").cast("decimal(18,2)").alias("total_price"),
    )
