"""Customer features.

Scale notes
-----------
* The fact table is read ONCE: it is reduced (map-side combined) to one row
  per (customer, day) with row counts, exact revenue and category counts;
  that small table is materialised and recency, frequency, monetary value,
  the purchase gap, the category mix and the streaks all derive from it. A
  customer holding a third of all rows costs one partial row per task and
  day.
* The mean gap between successive purchase rows telescopes: over rows sorted
  by date the gaps sum to (last - first), so the mean is
  ``datediff(max, min) / (n - 1)``. No per-customer sort is needed; the
  windowed form (``daily_gaps``) is kept for per-day output.
* Streaks come from the days as 64-bit words; a customer has one word for 64
  days of the calendar, whatever the number of purchases.
* Global fills (max gap) and standardisation statistics are one small
  aggregate job each whose few numbers enter the plan as literals: no
  single-partition window and no cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import bits as B
from basketry.functions import columns as C
from basketry.functions import dates as D

FEATURES = ["recency", "frequency", "monetary_value", "age", "gender_f", "gender_m", "aov",
            "avg_time_between_purchases", "longest_purchase_streak", "service_ratio",
            "product_ratio"]
PROFILE = ["recency", "frequency", "monetary_value", "aov", "avg_time_between_purchases",
           "longest_purchase_streak", "service_ratio", "product_ratio", "age"]


def customer_days(purchases: DataFrame, items: DataFrame | None) -> DataFrame:
    """The fact table reduced to one row per (customer, purchase day): every
    customer feature is a function of these rows, so the purchases are read
    once. Rows without a date form the (customer, NULL) group."""
    src = purchases
    if items is not None:
        src = purchases.join(items.select("item_id", "item_category"), "item_id", "left")
    cat = F.col("item_category") if items is not None else F.lit(None).cast("string")
    return src.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "purchase_date").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("item_id").alias("n_items"),
        F.sum("total_price").alias("revenue_dec"),
        F.count(F.when(cat == "Service", 1)).alias("n_service"),
        F.count(F.when(cat == "Product", 1)).alias("n_product"),
        F.count(cat).alias("n_cat"),
    )


def customer_aggregates(purchases: DataFrame, items: DataFrame | None,
                        ref_date: str, days: DataFrame | None = None) -> DataFrame:
    """A17 + A18 + A19 (closed form) + A21 in a single aggregation (over the
    (customer, day) table when given)."""
    d = days if days is not None else customer_days(purchases, items)
    dated = F.col("purchase_date").isNotNull()
    g = d.groupBy("customer_id").agg(
        F.max("purchase_date").alias("_last"),
        F.min("purchase_date").alias("_first"),
        F.sum(F.when(dated, F.col("n_rows")).otherwise(F.lit(0))).alias("_n_dated"),
        F.sum("n_items").alias("frequency"),
        F.coalesce(F.sum("revenue_dec"), F.lit(0)).cast("double").alias("monetary_value"),
        F.sum("n_service").alias("_n_service"),
        F.sum("n_product").alias("_n_product"),
        F.sum("n_cat").alias("_n_cat"),
    )
    return g.select(
        "customer_id",
        D.days_until(ref_date, "_last").alias("recency"),
        F.col("frequency").cast("bigint").alias("frequency"),
        "monetary_value",
        C.safe_ratio(F.col("monetary_value"), F.col("frequency")).alias("aov"),
        F.when(F.col("_n_dated") > 1,
               F.datediff("_last", "_first").cast("double") / (F.col("_n_dated") - 1))
        .alias("avg_time_between_purchases"),
        C.safe_ratio(F.col("_n_service"), F.col("_n_cat")).alias("service_ratio"),
        C.safe_ratio(F.col("_n_product"), F.col("_n_cat")).alias("product_ratio"),
    )


def rfm(purchases: DataFrame, ref_date: str) -> DataFrame:
    """A17 + A18: recency (days to ``ref_date``), frequency, monetary value, AOV."""
    return customer_aggregates(purchases, None, ref_date).select(
        "customer_id", "recency", "frequency", "monetary_value", "aov")


def daily_gaps(purchases: DataFrame) -> DataFrame:
    """Per (customer, day) the number of rows and the whole days since the
    customer's previous purchase day (NULL on the first day).

    Over rows sorted by date, the first row of a day carries ``gap_days`` and
    the other ``n_rows - 1`` rows of that day carry 0; this is the per-row gap
    list in compressed form. The window runs over distinct days only.
    """
    days = (purchases.where(F.col("customer_id").isNotNull() & F.col("purchase_date").isNotNull())
            .groupBy("customer_id", "purchase_date").agg(F.count(F.lit(1)).alias("n_rows")))
    w = Window.partitionBy("customer_id").orderBy("purchase_date")
    return days.select(
        "customer_id", "purchase_date", F.col("n_rows").cast("bigint").alias("n_rows"),
        F.datediff("purchase_date", F.lag("purchase_date").over(w)).cast("bigint")
        .alias("gap_days"))


def longest_streaks(purchases: DataFrame, epoch: str = "2023-01-01",
                    date_col: str = "purchase_date") -> DataFrame:
    """A20 + W2 + X3: longest run of consecutive purchase days per customer.

    The days of a customer are a set of 64-bit words (``functions.bits``), made
    by ``bit_or`` with map-side combining; runs are found inside the words and
    joined across them. No window and no sort of the rows. ``purchases`` may
    also be the (customer, day) table.
    """
    return B.longest_runs(day_words(purchases, epoch, date_col), ["customer_id"],
                          "longest_purchase_streak")


def day_words(purchases: DataFrame, epoch: str = "2023-01-01",
              date_col: str = "purchase_date") -> DataFrame:
    """(customer_id, word, bits): each customer's purchase days since ``epoch``
    (``bits.merge`` adds later days)."""
    return B.words(purchases.where(F.col("customer_id").isNotNull()), ["customer_id"],
                   D.day_index(date_col, epoch))


def demographics(customers: DataFrame, genders: Sequence[str] = ("F", "M")) -> DataFrame:
    """P16 + P7: age and one-hot gender per customer (NULL gender = all zeros)."""
    return customers.select(
        "customer_id", "age",
        *C.one_hot("gender", genders, prefix="gender"),
    ).select("customer_id", "age",
             *[F.col(f"gender_{g}").alias(f"gender_{g.lower()}") for g in genders])


MAX_GENDERS = 100


def gender_values(customers: DataFrame) -> list[str]:
    """Distinct non-null genders: each becomes a column, so more than
    ``MAX_GENDERS`` (dirty data) is an error rather than a wide table."""
    found = [r[0] for r in customers.select("gender").where(F.col("gender").isNotNull())
             .distinct().limit(MAX_GENDERS + 1).collect()]
    if len(found) > MAX_GENDERS:
        raise ValueError(f"more than {MAX_GENDERS} distinct genders: clean the column first")
    return sorted(found)


def customer_features(purchases: DataFrame, items: DataFrame, customers: DataFrame,
                      ref_date: str = "2023-12-31", epoch: str = "2023-01-01",
                      genders: Sequence[str] | None = ("F", "M")) -> DataFrame:
    """M1 + P17: one row per purchasing customer with the eleven features.

    Null rules: ratios 0, mean gap the largest mean gap of all customers,
    every other numeric value 0.
    """
    from basketry.session import materialize
    gs = list(genders) if genders is not None else gender_values(customers)
    # one pass over the fact table; the (customer, day) rows are read three
    # times below (aggregates, streaks, the max-gap fill)
    days = materialize(customer_days(purchases, items))
    agg = customer_aggregates(purchases, items, ref_date, days)
    streak = longest_streaks(days, epoch)
    demo = demographics(customers, gs)
    j = agg.join(demo, "customer_id", "left").join(streak, "customer_id", "left")
    max_gap = C.scalar(agg.select(F.max("avg_time_between_purchases")))
    gcols = [f"gender_{g.lower()}" for g in gs]
    return j.select(
        "customer_id", "recency", "frequency", "monetary_value",
        F.coalesce(F.col("age").cast("double"), F.lit(0.0)).alias("age"),
        *[F.coalesce(F.col(g), F.lit(0)).cast("int").alias(g) for g in gcols],
        F.coalesce("aov", F.lit(0.0)).alias("aov"),
        F.coalesce("avg_time_between_purchases", max_gap).alias("avg_time_between_purchases"),
        F.coalesce("longest_purchase_streak", F.lit(0)).cast("bigint")
        .alias("longest_purchase_streak"),
        F.coalesce("service_ratio", F.lit(0.0)).alias("service_ratio"),
        F.coalesce("product_ratio", F.lit(0.0)).alias("product_ratio"),
    )


def standardized_exprs(features: DataFrame, cols: Sequence[str] | None = None) -> dict:
    """M2 as column expressions: (x - mean) / population std, 0 for a
    zero-variance column. The statistics come from one aggregate job
    (2 x len(cols) numbers) and enter the expressions as literals, so the
    scaled values can be computed inside any later projection of the same
    rows (no join back to a scaled copy)."""
    cols = [c for c in (cols or FEATURES) if c in features.columns]
    st = C.column_stats(features, cols)
    out = {}
    for c in cols:
        mean, std = st[f"{c}__mean"], st[f"{c}__std"]
        out[c] = F.when(std > 0, (F.col(c).cast("double") - mean) / std).otherwise(F.lit(0.0))
    return out


def standardize(features: DataFrame, cols: Sequence[str] | None = None,
                keep: Sequence[str] = ("customer_id",), exprs: dict | None = None) -> DataFrame:
    """M2: the scaled feature table (see ``standardized_exprs``)."""
    ex = exprs if exprs is not None else standardized_exprs(features, cols)
    return features.select(*keep, *[e.alias(c) for c, e in ex.items()])


def standardization_stats(features: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean and population std per feature in long form (feature, mean, std)."""
    cols = [c for c in (cols or FEATURES) if c in features.columns]
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std")]
    wide = features.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {stack}) as (feature, mean, std)"))
