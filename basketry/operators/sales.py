"""Sales report operators.

Scale notes
-----------
* Item-level metrics are aggregated on ``item_id`` *before* the items join
  (``item_totals``): the partial aggregate collapses the fact table map-side,
  so the join and the name/category roll-ups touch one row per item, not one
  per purchase. A hot item only changes one partial-aggregate row per task.
* The dimension join is left to the planner: the items side is broadcast when
  its statistics are under ``spark.sql.autoBroadcastJoinThreshold``,
  otherwise a shuffle join on ``item_id`` runs (no unchecked ``broadcast()``).
* Top/bottom lists use ``TakeOrderedAndProject`` (see ``ranking.head``).
* Customer spend is computed on the purchases alone (sum and count per
  customer); the segment roll-up joins one row per customer, not per purchase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import ranking, stats
from basketry.session import materialize


def merged(purchases: DataFrame, items: DataFrame, customers: DataFrame) -> DataFrame:
    """J1 + J2: purchases enriched with item and customer attributes (left joins).
    The items' names, the widest columns, come last, so no shuffle carries them
    beside a purchase."""
    rest = [c for f in (purchases, items, customers) for c in f.columns
            if c not in ("item_id", "customer_id")]
    return (purchases.join(customers, "customer_id", "left").join(items, "item_id", "left")
            .select("customer_id", "item_id", *rest))


def fill_employee(purchases: DataFrame, value: str = "Unknown") -> DataFrame:
    """Missing employee ids become ``value``."""
    return purchases.na.fill(value, ["employee_id"])


def item_totals(purchases: DataFrame) -> DataFrame:
    """Rows and exact revenue per item id (map-side combined)."""
    price = _price(purchases)
    return purchases.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(price).alias("revenue_dec"),
        F.count(price).alias("n_priced"),
    )


def _price(purchases: DataFrame):
    """The price column; where it is absent, NULL for every row."""
    if "total_price" in purchases.columns:
        return F.col("total_price")
    return F.lit(None).cast("decimal(18,2)")


def item_facts(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """One row per purchased item id: totals plus the item attributes (NULL
    for ids missing from the catalogue)."""
    attrs = [c for c in ("item_name", "item_category", "item_subcategory") if c in items.columns]
    return item_totals(purchases).join(items.select("item_id", *attrs), "item_id", "left")


def by_attribute(purchases: DataFrame, items: DataFrame | None, attr: str) -> DataFrame:
    """Purchase rows and revenue per item attribute (name, category, subcategory).

    Rows whose attribute is NULL (unknown item, missing value) are dropped, as
    a group-by over a pandas column drops them. Revenue of a group whose prices
    are all NULL is 0. With ``items=None`` the first argument is an
    ``item_facts`` frame (already reduced to one row per item).
    """
    if items is None:
        t = purchases
    else:
        t = item_totals(purchases).join(items.select("item_id", attr), "item_id", "left")
    return (t.where(F.col(attr).isNotNull())
            .groupBy(attr)
            .agg(F.sum("n_rows").cast("bigint").alias("n_purchases"),
                 F.coalesce(F.sum("revenue_dec"), F.lit(0)).cast("double").alias("revenue")))


ATTRIBUTES = ("item_name", "item_category", "item_subcategory")


def attribute_totals(facts: DataFrame, attrs=ATTRIBUTES) -> DataFrame:
    """Rows and revenue per value of each item attribute in ONE aggregation
    (grouping sets over the per-item facts): level, key, n_purchases, n_priced
    (rows with a price), revenue.
    NULL attribute values are dropped."""
    g = facts.groupingSets([[a] for a in attrs], *attrs).agg(
        F.sum("n_rows").cast("bigint").alias("n_purchases"),
        F.sum("n_priced").cast("bigint").alias("n_priced"),
        F.coalesce(F.sum("revenue_dec"), F.lit(0)).cast("double").alias("revenue"),
        *[F.grouping(a).alias(f"_g_{a}") for a in attrs])
    level = None
    key = None
    for a in attrs:
        here = F.col(f"_g_{a}") == 0
        level = F.when(here, F.lit(a)) if level is None else level.when(here, F.lit(a))
        key = F.when(here, F.col(a)) if key is None else key.when(here, F.col(a))
    return (g.select(level.alias("level"), key.alias("key"), "n_purchases", "n_priced", "revenue")
            .where(F.col("key").isNotNull()))


def level(totals: DataFrame, attr: str) -> DataFrame:
    """One attribute's rows of ``attribute_totals`` (same shape as ``by_attribute``)."""
    return totals.where(F.col("level") == attr).select(
        F.col("key").alias(attr), "n_purchases", "revenue")


def top_by_count(purchases: DataFrame, items: DataFrame, attr: str, n: int = 10) -> DataFrame:
    """A1/A3/A4: the n attribute values with the most purchase rows."""
    return ranking.head(by_attribute(purchases, items, attr), attr, "n_purchases", n)


def bottom_by_count(purchases: DataFrame, items: DataFrame, attr: str, n: int = 10) -> DataFrame:
    """A2/A5: the last n of the descending count list (rank 1 = fewest).

    The descending list breaks ties by key ascending, so its tail is the first
    n by (count ascending, key descending).
    """
    return ranking.head(by_attribute(purchases, items, attr), attr, "n_purchases", n,
                        descending=False, key_descending=True)


def top_by_revenue(purchases: DataFrame, items: DataFrame, attr: str, n: int = 10) -> DataFrame:
    """The n attribute values with the largest revenue."""
    return ranking.head(by_attribute(purchases, items, attr), attr, "revenue", n)


def bottom_by_revenue(purchases: DataFrame, items: DataFrame, attr: str, n: int = 10) -> DataFrame:
    """The n smallest revenues, ascending, ties by key ascending."""
    return ranking.head(by_attribute(purchases, items, attr), attr, "revenue", n,
                        descending=False)


def share(purchases: DataFrame, items: DataFrame, attr: str = "item_category",
          metric: str = "revenue") -> DataFrame:
    """Each group's percentage of the total volume or revenue.

    The window over all groups runs on the aggregated frame (one row per
    category), never on purchase rows.
    """
    g = by_attribute(purchases, items, attr)
    total = F.sum(metric).over(Window.partitionBy())
    return g.select(attr, metric, (F.col(metric) * 100.0 / total).alias("share_pct"))


def customer_totals(purchases: DataFrame) -> DataFrame:
    """Exact spend sum and priced-row count per customer (map-side combined)."""
    return (purchases.where(F.col("customer_id").isNotNull())
            .groupBy("customer_id")
            .agg(F.sum(_price(purchases)).alias("s"), F.count(_price(purchases)).alias("c")))


def customer_mean_spend(purchases: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """A10: mean line value per customer (NULL customers dropped)."""
    t = totals if totals is not None else customer_totals(purchases)
    return (t.where(F.col("c") > 0)
            .select("customer_id", (F.col("s").cast("double") / F.col("c")).alias("mean_spend")))


def spend_distribution(purchases: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """A11 + A12: count, mean, sample std, min, quartiles and max of the
    per-customer means (the overall average is the unweighted mean of means).
    One row. The means are reduced from the purchases once."""
    per = customer_mean_spend(purchases, totals if totals is not None
                              else materialize(customer_totals(purchases)))
    qs = [F.lit(v).cast("double") for v in stats.quantiles(per, "mean_spend", [0.25, 0.5, 0.75])]
    return per.agg(
        F.count("mean_spend").cast("bigint").alias("count"),
        F.avg("mean_spend").alias("mean"),
        F.stddev_samp("mean_spend").alias("std"),
        F.min("mean_spend").alias("min"),
        qs[0].alias("p25"), qs[1].alias("p50"), qs[2].alias("p75"),
        F.max("mean_spend").alias("max"),
    )


def spend_by_segment(purchases: DataFrame, customers: DataFrame,
                     segment_col: str = "segment", totals: DataFrame | None = None) -> DataFrame:
    """Mean line value per customer segment (purchase-weighted).

    Purchases are first reduced to (sum, count) per customer, so the join to
    the customer dimension carries one row per customer.
    """
    per = totals if totals is not None else customer_totals(purchases)
    j = per.join(customers.select("customer_id", segment_col), "customer_id", "left")
    return (j.where(F.col(segment_col).isNotNull())
            .groupBy(segment_col)
            .agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
            .where(F.col("c") > 0)
            .select(segment_col, (F.col("s").cast("double") / F.col("c")).alias("mean_spend")))

