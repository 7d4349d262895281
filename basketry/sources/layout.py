"""Purchases laid out for joins by customer.

Purchases are written once as a table bucketed by (customer_id, salt) and
sorted inside the buckets; the salt is a hash of the row, so a customer with a
large part of all rows lies in several buckets. Tables with one row a customer
are written with each row once for every salt, in the same buckets. A join on
both columns then reads matching buckets side by side: the purchases are not
shuffled again, whatever number of joins follow, and aggregates by (customer_id,
salt) are complete inside a bucket before the small step to the customer.

The layout pays when it is written once and joined often. The number of buckets
belongs to a table: about its size over 128 MB, the same for tables that meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import checkpoint_dir

KEYS = ("customer_id", "salt")
SALTS = 4


def _write(df: DataFrame, name: str, path: str | None, buckets: int, sort: tuple) -> DataFrame:
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    # dealt as the buckets are, so every bucket is one sorted file
    (df.repartition(buckets, *KEYS).write.format("parquet").mode("overwrite")
     .bucketBy(buckets, *KEYS).sortBy(*KEYS, *sort).option("path", path).saveAsTable(name))
    return spark.table(name)


def _name(name: str | None) -> str:
    return name or f"basketry_{uuid.uuid4().hex}"


def bucket_purchases(purchases: DataFrame, name: str | None = None, buckets: int = 16,
                     salts: int = SALTS, path: str | None = None) -> DataFrame:
    """The purchases with a ``salt``, as a bucketed and sorted table. Rows
    without a customer keep a null id."""
    salt = F.pmod(F.xxhash64(*purchases.columns), F.lit(salts)).cast("int")
    sort = tuple(c for c in ("purchase_date", "item_id") if c in purchases.columns)
    return _write(purchases.withColumn("salt", salt), _name(name), path, buckets, sort)


def bucket_customers(customers: DataFrame, name: str | None = None, buckets: int = 16,
                     salts: int = SALTS, path: str | None = None) -> DataFrame:
    """A table with one row a customer, once for every salt, in the buckets of
    ``bucket_purchases``."""
    spread = customers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _write(spread, _name(name), path, buckets, ())


def join_customers(purchases: DataFrame, customers: DataFrame, how: str = "left") -> DataFrame:
    """Purchases with the columns of ``customers``, both bucketed."""
    return purchases.join(customers, list(KEYS), how).drop("salt")


def by_customer(purchases: DataFrame, *aggregates) -> DataFrame:
    """One row for each customer and salt of bucketed purchases, without a
    shuffle; sums and counts of them follow by customer."""
    return purchases.groupBy(*KEYS).agg(*aggregates)


def drop(spark: SparkSession, *tables: str) -> None:
    """Forget the tables; their files stay where they were written."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{t}`")
