"""Customers' items as sets of 64-bit words (A26, X1, R16; ``functions.bits``).

A customer's set has one row for 64 neighbouring item numbers that hold any of
its items, so counts and overlaps of customers with long histories move words
instead of items, and no list of items is built. Whole-number item ids are used
as they are; other ids need an index (``interactions.dense_index``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import bits as B

KEY = ["customer_id"]


def item_sets(pairs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(customer_id, word, bits) of (customer_id, item_id) rows, repeats allowed.
    ``index``: (item_id, item_idx) for ids that are not whole numbers."""
    own = pairs.select("customer_id", "item_id").where("customer_id is not null")
    if index is not None:
        return B.words(own.join(index, "item_id"), KEY, F.col("item_idx"))
    if not isinstance(own.schema["item_id"].dataType, T.IntegralType):
        raise ValueError("item ids that are not whole numbers need an index")
    return B.words(own, KEY, F.col("item_id"))


def items_per_user(matrix: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(customer_id, n_items), the different items bought (quantity > 0); a
    customer without any has 0."""
    found = B.sizes(item_sets(matrix.where("quantity > 0"), index), KEY, "n_items")
    none = matrix.groupBy("customer_id").agg(F.max("quantity").alias("_q")).where(
        "_q <= 0 and customer_id is not null")
    return found.unionByName(none.select("customer_id", F.lit(0).cast("bigint").alias("n_items")))


def precision_recall(recs: DataFrame, actual: DataFrame, k: int = 5,
                     index: DataFrame | None = None) -> DataFrame:
    """R16 + X1 as ``recommend.precision_recall``, by the overlap of two sets."""
    bought = item_sets(actual, index)
    n = B.sizes(bought, KEY, "_n")
    hits = B.common(bought, item_sets(recs, index), KEY, "_hits")
    hit = F.coalesce("_hits", F.lit(0)).cast("double")
    return n.join(hits, "customer_id", "left").select(
        "customer_id", (hit / F.lit(float(k))).alias("precision"),
        (hit / F.col("_n")).alias("recall"))
