"""User-item interactions.

The user-item matrix is kept LONG and SPARSE: (customer_id, item_id,
quantity) with one row per non-zero cell. A dense users x items grid is never
built (at 15e3 x 2e4 it is already 3e8 cells).

Scale notes
-----------
* The matrix is one ``groupBy(customer, item)``: map-side partial sums make a
  hot (customer, item) pair one row per task before the shuffle.
* Per-item min/max "including the implicit zeros" needs no grid: the minimum
  is 0 unless the item has an entry for every active user.
* Dense id encoding (``dense_index``) sorts ids with a range partitioning and
  joins one offset per range: no single-partition window over ids, no id list
  on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import dates as D
from basketry.operators import ranking


def preprocess_customers(customers: DataFrame, unknown: str = "Unknown",
                         genders=("F", "M", "Unknown")) -> DataFrame:
    """R1 = P3 + P4 + P5 + P6 + P7: mean age for missing ages, unknown gender,
    subscriptions as 0/1 and one-hot gender."""
    from basketry.functions.columns import scalar
    mean_age = scalar(customers.select(F.avg("age").cast("double")))
    g = F.coalesce(F.col("gender"), F.lit(unknown))
    others = [c for c in customers.columns
              if c not in ("age", "gender", "email_subscription", "sms_subscription",
                           "registration_date")]
    return customers.select(
        *others,
        F.coalesce(F.col("age").cast("double"), mean_age).alias("age"),
        F.to_date("registration_date").alias("registration_date"),
        F.col("email_subscription").cast("int").alias("email_subscription"),
        F.col("sms_subscription").cast("int").alias("sms_subscription"),
        *[(g == F.lit(v)).cast("int").alias(f"gender_{v.lower()}") for v in genders],
    )


def preprocess_items(items: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """NULL strings become ``unknown`` (numeric columns are left alone)."""
    return items.na.fill(unknown)


def user_item_matrix(purchases: DataFrame) -> DataFrame:
    """Summed quantity per (customer, item); absent cells are the fill value 0."""
    return (purchases.where(F.col("customer_id").isNotNull() & F.col("item_id").isNotNull())
            .groupBy("customer_id", "item_id")
            .agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("quantity")))


def items_per_user(matrix: DataFrame) -> DataFrame:
    """Distinct items bought (quantity > 0) per user."""
    return matrix.groupBy("customer_id").agg(
        F.count(F.when(F.col("quantity") > 0, 1)).cast("bigint").alias("n_items"))


def active_users(matrix: DataFrame, min_items: int = 5) -> DataFrame:
    """Users with at least ``min_items`` distinct items bought."""
    if min_items <= 0:
        return matrix.select("customer_id").distinct()
    return items_per_user(matrix).where(F.col("n_items") >= min_items).select("customer_id")


def interactions(purchases: DataFrame, min_items: int = 5) -> DataFrame:
    """R3 = A25 + P19: the matrix restricted to active users (left-semi join on
    an aggregate that is already partitioned by customer)."""
    m = user_item_matrix(purchases)
    return m.join(active_users(m, min_items), "customer_id", "left_semi")


def positive(matrix: DataFrame) -> DataFrame:
    """P20."""
    return matrix.where(F.col("quantity") > 0)


def popularity(active_matrix: DataFrame, all_matrix: DataFrame | None = None) -> DataFrame:
    """A27 (unranked): total quantity per item over active users. Items bought
    only by inactive users stay in the list with 0, as matrix columns do."""
    pop = active_matrix.groupBy("item_id").agg(F.sum("quantity").cast("bigint").alias("popularity"))
    if all_matrix is None:
        return pop
    cols = all_matrix.select("item_id").distinct()
    return cols.join(pop, "item_id", "left").select(
        "item_id", F.coalesce("popularity", F.lit(0)).cast("bigint").alias("popularity"))


def item_ranges(active_matrix: DataFrame, items: DataFrame) -> DataFrame:
    """A28 + V11: per catalogue item, min and max quantity over active users
    counting their implicit zeros; ``scale`` is max - min with 0 replaced by 1."""
    from basketry.functions.columns import scalar
    n_users = scalar(active_matrix.select(F.countDistinct("customer_id")))
    # without an active user no item has an entry and every range is 0 to 0
    per = active_matrix.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("quantity").alias("_min"),
        F.max("quantity").alias("_max"))
    j = items.select("item_id").join(per, "item_id", "left")
    full = F.coalesce(F.col("_n") >= n_users, F.lit(False))
    lo = F.when(full, F.col("_min")).otherwise(F.least(F.coalesce("_min", F.lit(0)), F.lit(0)))
    hi = F.when(full, F.col("_max")).otherwise(F.greatest(F.coalesce("_max", F.lit(0)), F.lit(0)))
    return j.select("item_id", lo.cast("double").alias("data_min"),
                    hi.cast("double").alias("data_max")).withColumn(
        "scale", F.when(F.col("data_max") - F.col("data_min") == 0, F.lit(1.0))
        .otherwise(F.col("data_max") - F.col("data_min")))


def minmax_scale(active_matrix: DataFrame, ranges: DataFrame) -> DataFrame:
    """(q - min) / scale on the stored entries. Implicit zeros stay 0:
    an item with min > 0 has an entry for every active user. The entries may
    also be new vectors (any customer, long form): they are scaled with the
    fitted ranges, and items without a range are left out. ``ranges=None``
    (nothing fitted yet) raises."""
    if ranges is None:
        raise ValueError("Fit the item ranges before scaling new interactions.")
    return active_matrix.join(ranges, "item_id").select(
        "customer_id", "item_id",
        ((F.col("quantity") - F.col("data_min")) / F.col("scale")).alias("value"))


def inverse_scale(scores: DataFrame, ranges: DataFrame, col: str = "score") -> DataFrame:
    """P * scale + min per item."""
    return scores.join(ranges, "item_id").withColumn(
        col, F.col(col) * F.col("scale") + F.col("data_min")).drop(
        "data_min", "data_max", "scale")


def dense_index(df: DataFrame, col: str, out: str, partitions: int | None = None) -> DataFrame:
    """0-based dense position of each distinct ``col`` in sorted order.

    Positions come from ``ranking.positions``: range partitions and a join
    with their offsets.
    """
    ids = df.select(col).where(F.col(col).isNotNull()).distinct()
    return ranking.positions(ids, [F.col(col)], out, partitions)


def test_cutoff(purchases: DataFrame, months: int = 3) -> DataFrame:
    """Latest purchase date and the cut ``months`` calendar months earlier."""
    return purchases.agg(F.max("purchase_date").alias("latest_date")).select(
        "latest_date", D.minus_months("latest_date", months).alias("cutoff_date"))


def temporal_split(purchases: DataFrame, months: int = 3) -> DataFrame:
    """R8 + A30 + P21 + V18: per customer whether it has purchases before the
    cut (train) and on/after it (test); the two sets may overlap."""
    from basketry.functions.columns import scalar
    cut = scalar(purchases.select(D.minus_months(F.max("purchase_date"), months)))
    return (purchases.where(F.col("customer_id").isNotNull())
            .groupBy("customer_id").agg(
                F.max((F.col("purchase_date") < cut).cast("int")).cast("boolean").alias("in_train"),
                F.max((F.col("purchase_date") >= cut).cast("int")).cast("boolean").alias("in_test")))


def register_customers(known: DataFrame, new: DataFrame) -> DataFrame:
    """Add customers not yet known (zero interactions) to the known set."""
    fresh = new.select("customer_id").join(known.select("customer_id"), "customer_id", "left_anti")
    return known.select("customer_id").unionByName(fresh.distinct())


def history(matrix: DataFrame, items: DataFrame) -> DataFrame:
    """A31 (long form): item names a customer bought (quantity > 0), one row
    per item id."""
    return positive(matrix).join(items.select("item_id", "item_name"), "item_id", "left").select(
        "customer_id", "item_id", "item_name")
