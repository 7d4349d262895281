"""A16 + A34: the sales report as one long-form frame.

Schema: section, key, value, rank, message. The fact table is reduced twice,
to one row per item and one per customer; every section is computed from
those written tables. A section whose column is absent or entirely NULL
yields one row with the "Cannot be determined" message instead; one small
aggregate over the reductions decides that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import ranking, sales
from basketry.session import materialize

REPORT_SCHEMA = "section string, key string, value double, rank int, message string"


def _rows(df: DataFrame, section: str, key: str | None, value: str,
          with_rank: bool = True) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.col(value).cast("double").alias("value"),
        (F.col("rank").cast("int") if with_rank else F.lit(None).cast("int")).alias("rank"),
        F.lit(None).cast("string").alias("message"),
    )


def _message(section: str, what: str) -> tuple:
    return (section, None, None, None, f"Cannot be determined (missing {what} data)")


def _ranked(totals: DataFrame, attr: str, metric: str, n: int, descending: bool,
            key_descending: bool) -> DataFrame:
    return ranking.head(sales.level(totals, attr), attr, metric, n,
                        descending=descending, key_descending=key_descending)


# Sections, and the column names that their messages give.
#   section, attribute, metric, metric descending, key descending, guard text
LISTS = [
    ("top_selling_items", "item_name", "n_purchases", True, False, "ItemName"),
    ("bottom_selling_items", "item_name", "n_purchases", False, True, "ItemName"),
    ("top_selling_categories", "item_category", "n_purchases", True, False, "ItemCategory"),
    ("top_selling_subcategories", "item_subcategory", "n_purchases", True, False,
     "ItemSubcategory"),
    ("bottom_selling_subcategories", "item_subcategory", "n_purchases", False, True,
     "ItemSubcategory"),
    ("revenue_top_items", "item_name", "revenue", True, False, "ItemName or TotalPrice"),
    ("revenue_bottom_items", "item_name", "revenue", False, False, "ItemName or TotalPrice"),
    ("revenue_top_categories", "item_category", "revenue", True, False,
     "ItemCategory or TotalPrice"),
    ("revenue_top_subcategories", "item_subcategory", "revenue", True, False,
     "ItemSubcategory or TotalPrice"),
]
SPENDING, SEGMENT = "CustomerID or TotalPrice", "CustomerSegment or TotalPrice"
QUARTILES = [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
             ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max")]


def sales_report(purchases: DataFrame, items: DataFrame, customers: DataFrame,
                 n: int = 10, segment_col: str = "segment") -> DataFrame:
    """A list needs its attribute, a revenue list also a price in any
    purchase; spending needs customer ids and prices; the segment means need
    segments and prices."""
    spark = purchases.sparkSession
    per_item = materialize(sales.item_facts(purchases, items))
    attrs = [a for a in sales.ATTRIBUTES if a in per_item.columns]
    guard = per_item.agg(F.sum("n_priced").alias("priced"),
                         *[F.count(a).alias(a) for a in attrs]).first().asDict()
    priced = bool(guard.pop("priced"))
    present = {a for a in attrs if guard[a]}
    parts: list[DataFrame] = []
    messages: list[tuple] = []
    if present:
        facts = materialize(sales.attribute_totals(per_item, [a for a in attrs if a in present]))
    for section, attr, metric, md, kd, what in LISTS:
        if attr in present and (priced or metric != "revenue"):
            parts.append(_rows(_ranked(facts, attr, metric, n, md, kd), section, attr, metric))
        else:
            messages.append(_message(section, what))
    if priced and "customer_id" in purchases.columns:
        totals = materialize(sales.customer_totals(purchases))
        spending = bool(totals.where(F.col("c") > 0).take(1))
    else:
        totals, spending = None, False
    if spending:
        per = sales.customer_mean_spend(purchases, totals)
        parts.append(_rows(per, "customer_spending_per_customer", "customer_id", "mean_spend",
                           with_rank=False))
        row = sales.spend_distribution(purchases, totals=totals).first()
        parts.append(spark.createDataFrame(
            [("customer_spending_overall_average", None, row["mean"], None, None)]
            + [("customer_spending_distribution", key,
                None if row[name] is None else float(row[name]), None, None)
               for key, name in QUARTILES], REPORT_SCHEMA))
    else:
        messages.append(_message("customer_spending", SPENDING))
    segments = None
    if spending and segment_col in customers.columns:
        segments = materialize(sales.spend_by_segment(purchases, customers, segment_col,
                                                      totals=totals))
    if segments is not None and segments.take(1):
        parts.append(_rows(segments, "customer_spending_by_segment", segment_col, "mean_spend",
                           with_rank=False))
    else:
        messages.append(_message("customer_spending_by_segment", SEGMENT))
    if messages:
        parts.append(spark.createDataFrame(messages, REPORT_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dashboard(purchases: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """The dashboard's first-n cuts plus the leading subcategory by revenue."""
    facts = materialize(sales.attribute_totals(sales.item_facts(purchases, items),
                                               ("item_name", "item_subcategory")))
    cuts = [
        ("top_items", "item_name", "n_purchases", True, False),
        ("bottom_items", "item_name", "n_purchases", False, True),
        ("top_subcategories", "item_subcategory", "n_purchases", True, False),
        ("top_items_revenue", "item_name", "revenue", True, False),
        ("bottom_items_revenue", "item_name", "revenue", False, False),
        ("top_subcategories_revenue", "item_subcategory", "revenue", True, False),
        ("leading_subcategory_revenue", "item_subcategory", "revenue", True, False),
    ]
    out = None
    for section, attr, metric, md, kd in cuts:
        k = 1 if section.startswith("leading") else n
        part = _rows(_ranked(facts, attr, metric, k, md, kd), section, attr,
                     metric).drop("message")
        out = part if out is None else out.unionByName(part)
    return out
