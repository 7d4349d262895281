"""Synthetic data generator (S10-S13, P9-P15) as Spark jobs.

Every random draw is a hashed uniform of (row id, salt, seed), so the output
depends only on the seed and sizes, never on the partitioning, and any number
of rows can be generated in parallel from ``spark.range``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import catalog

START_DATE = "2023-01-01"
END_DATE = "2023-12-31"
SERVICE_SHARE = 0.7


def uniform(seed: int, salt: str, *cols: Column | str) -> Column:
    """Deterministic U[0, 1) from a 64-bit hash of the key columns."""
    h = F.xxhash64(F.lit(seed), F.lit(salt), *cols)
    return (F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53))


def pick(values: list[str], u: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * len(values)) + 1).cast("int"))


def gen_customers(spark: SparkSession, n: int = 500, seed: int = 42,
                  with_segment: bool = False) -> DataFrame:
    """Ids Cust0001.., age 18..75, F/M, registration up to 730 days before
    2023-01-01, a zip code, two subscription flags; P14 segment on request."""
    r = spark.range(n)
    u = lambda salt: uniform(seed, salt, "id")
    cols = [
        F.format_string("Cust%04d", F.col("id") + 1).alias("customer_id"),
        (F.floor(u("age") * 58) + 18).cast("int").alias("age"),
        F.when(u("gender") < 0.5, "F").otherwise("M").alias("gender"),
        F.date_sub(F.lit(START_DATE).cast("date"), F.floor(u("reg") * 731).cast("int"))
        .alias("registration_date"),
        pick(catalog.ZIP_CODES, u("zip")).alias("zip_code"),
        (u("email") < 0.5).alias("email_subscription"),
        (u("sms") < 0.5).alias("sms_subscription"),
    ]
    if with_segment:
        s = u("segment")
        cols.append(F.when(s < 0.4, "Regular").when(s < 0.8, "Occasional").otherwise("New")
                    .alias("segment"))
    return r.select(*cols)


def gen_items(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The catalogue with category (P9), subcategory (P10) and a unit
    price drawn from its range (P11)."""
    names = catalog.SERVICES + catalog.PRODUCTS
    df = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "pos int, item_name string")
    df = df.select(F.format_string("Item%04d", "pos").alias("item_id"), "item_name",
                   catalog.category("item_name").alias("item_category"),
                   catalog.classify("item_name").alias("item_subcategory"))
    return df.withColumn("unit_price", catalog.draw_price(
        "item_category", "item_subcategory", uniform(seed, "price", "item_id")))


def gen_purchases(spark: SparkSession, customers: DataFrame, n: int = 5000,
                  seed: int = 42, n_customers: int | None = None,
                  with_preference: bool = False) -> DataFrame:
    """S12 + P12 + P15: a random customer per row, a day between registration
    and 2023-12-31 (rows of customers registered later are skipped), 70 %
    services (quantity 1, an employee) and 30 % products (quantity 1..3), and a
    price drawn per row from the item's range. ``with_preference`` adds P13:
    the customer's preferred service on service rows, preferred product
    otherwise (one hashed pick of each per customer)."""
    nc = n_customers if n_customers is not None else customers.count()
    r = spark.range(n)
    u = lambda salt: uniform(seed, salt, "id")
    svc = u("kind") < SERVICE_SHARE
    n_s, n_p = len(catalog.SERVICES), len(catalog.PRODUCTS)
    s_idx = F.floor(u("service") * n_s).cast("int")
    p_idx = F.floor(u("product") * n_p).cast("int")
    rows = r.select(
        "id",
        F.format_string("Cust%04d", F.floor(u("customer") * nc).cast("int") + 1).alias("customer_id"),
        F.when(svc, pick(catalog.SERVICES, u("service")))
        .otherwise(pick(catalog.PRODUCTS, u("product"))).alias("item_name"),
        F.format_string("Item%04d", F.when(svc, s_idx + 1).otherwise(p_idx + n_s + 1))
        .alias("item_id"),
        F.when(svc, F.lit(1)).otherwise(F.floor(u("qty") * 3).cast("int") + 1).alias("quantity"),
        F.when(svc, F.format_string("Emp%02d", F.floor(u("emp") * catalog.N_EMPLOYEES).cast("int") + 1))
        .alias("employee_id"),
        u("day").alias("_u_day"), u("price").alias("_u_price"),
    )
    j = rows.join(customers.select("customer_id", "registration_date"), "customer_id")
    span = F.datediff(F.lit(END_DATE).cast("date"), F.col("registration_date"))
    j = j.where(span > 0)
    cat = catalog.category("item_name")
    sub = catalog.classify("item_name")
    unit = catalog.draw_price(cat, sub, F.col("_u_price"))
    cols = [
        "customer_id", "item_id", F.col("quantity").cast("int").alias("quantity"),
        F.date_add("registration_date", F.floor(F.col("_u_day") * (span + 1)).cast("int"))
        .alias("purchase_date"),
        (unit * F.col("quantity")).cast("decimal(18,2)").alias("total_price"),
        "employee_id",
    ]
    if with_preference:
        pref_s = pick(catalog.SERVICES, uniform(seed, "pref_service", "customer_id"))
        pref_p = pick(catalog.PRODUCTS, uniform(seed, "pref_product", "customer_id"))
        cols.append(F.when(cat == "Service", pref_s).otherwise(pref_p)
                    .alias("preferred_category"))
    return j.select(*cols)


def write_generated(customers: DataFrame, items: DataFrame, purchases: DataFrame,
                    out_dir: str) -> None:
    """The three tables as CSV with the documented headers."""
    from basketry.sources import schemas
    from basketry.sources.files import write_table
    for name, df in (("customers", customers), ("items", items), ("purchases", purchases)):
        fields = getattr(schemas, name.upper()).names
        named = df.select(*[F.col(f).alias(h) for f, h in zip(fields, schemas.CSV_HEADERS[name])],
                          *[c for c in df.columns if c not in fields])
        write_table(named, f"{out_dir}/{name}", "csv")
