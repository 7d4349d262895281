"""Batch answers (purchase history + recommendations) per requested id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import interactions as I


def history_arrays(requests: DataFrame, active_matrix: DataFrame, items: DataFrame) -> DataFrame:
    """Sorted item names per requester; empty for customers under the
    activity threshold (they are not rows of the filtered matrix)."""
    h = (I.history(active_matrix, items).where(F.col("item_name").isNotNull())
         .groupBy("customer_id")
         .agg(F.array_sort(F.collect_list("item_name")).alias("purchase_history")))
    return requests.join(h, "customer_id", "left").select(
        "customer_id", F.coalesce("purchase_history", F.array().cast("array<string>"))
        .alias("purchase_history"))


def recommendation_arrays(requests: DataFrame, named_recs: DataFrame) -> DataFrame:
    """Recommended names in rank order (at most k per user)."""
    r = (named_recs.groupBy("customer_id")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "item_name"))).alias("_r"))
         .select("customer_id", F.transform("_r", lambda x: x["item_name"])
                 .alias("recommendations")))
    return requests.join(r, "customer_id", "left").select(
        "customer_id", F.coalesce("recommendations", F.array().cast("array<string>"))
        .alias("recommendations"))


def batch(requests: DataFrame, active_matrix: DataFrame, named_recs: DataFrame,
          items: DataFrame) -> DataFrame:
    """customer_id, purchase_history array<string>, recommendations array<string>."""
    return history_arrays(requests, active_matrix, items).join(
        recommendation_arrays(requests, named_recs), "customer_id")


def history_strings(requests: DataFrame, active_matrix: DataFrame, items: DataFrame) -> DataFrame:
    return history_arrays(requests, active_matrix, items).select(
        "customer_id", F.array_join("purchase_history", "|").alias("purchase_history"))


def batch_strings(requests: DataFrame, active_matrix: DataFrame, named_recs: DataFrame,
                  items: DataFrame) -> DataFrame:
    return batch(requests, active_matrix, named_recs, items).select(
        "customer_id", F.array_join("purchase_history", "|").alias("purchase_history"),
        F.array_join("recommendations", "|").alias("recommendations"))
