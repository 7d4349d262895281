"""Registered queries over the star-schema tables and their DuckDB oracles.

``QUERIES[name](spark, sf_dir)`` returns a Spark DataFrame; ``ORACLE[name]``
is the same computation in plain SQL over the raw tables. Doubles are rounded
to 6 places on both sides so the comparison does not depend on summation
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators import sales
from basketry.plans import sales_report
from basketry.sources import warehouse as wh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (the comparison representation)."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def item_tables(spark: SparkSession, sf_dir: str):
    """What item-only lists need: purchase lines without their orders, items."""
    return wh.purchase_lines(spark, sf_dir), wh.items(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str):
    return wh.purchases(spark, sf_dir), wh.items(spark, sf_dir), wh.customers(spark, sf_dir)


# ---------------------------------------------------------------- SQL prelude
BASE = """
purchases AS (
  SELECT o.o_custkey AS customer_id, l.l_partkey AS item_id,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(o.o_orderdate AS DATE) AS purchase_date,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS total_price,
         CASE WHEN l.l_linenumber % 2 = 1
              THEN printf('Emp%02d', CAST(l.l_suppkey % 10 + 1 AS INTEGER)) END AS employee_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
items AS (
  SELECT p_partkey AS item_id, p_name AS item_name,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM') THEN 'Service'
              ELSE 'Product' END AS item_category,
         p_brand AS item_subcategory, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price
  FROM part),
customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 17 = 0 THEN NULL
              ELSE CAST(c_custkey % 58 + 18 AS INTEGER) END AS age,
         CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F'
              ELSE 'M' END AS gender,
         DATE '1994-01-01' + CAST(c_custkey % 730 AS INTEGER) AS registration_date,
         CAST(c_nationkey AS VARCHAR) AS zip_code,
         c_acctbal > 0 AS email_subscription, c_custkey % 3 = 0 AS sms_subscription,
         c_mktsegment AS segment
  FROM customer),
item_totals AS (
  SELECT item_id, count(*) AS n_rows, sum(total_price) AS revenue_dec
  FROM purchases GROUP BY item_id)"""


def by_attr_sql(attr: str) -> str:
    return f"""
by_{attr} AS (
  SELECT i.{attr}, CAST(sum(t.n_rows) AS BIGINT) AS n_purchases,
         CAST(coalesce(sum(t.revenue_dec), 0) AS DOUBLE) AS revenue
  FROM item_totals t LEFT JOIN items i ON t.item_id = i.item_id
  WHERE i.{attr} IS NOT NULL GROUP BY i.{attr})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join((BASE,) + ctes)


def ranked_sql(attr: str, metric: str, n: int, metric_desc: bool, key_desc: bool) -> str:
    order = (f"{metric} {'DESC' if metric_desc else 'ASC'}, "
             f"{attr} {'DESC' if key_desc else 'ASC'}")
    return (with_(by_attr_sql(attr)) + f"""
SELECT {attr}, {'round(' + metric + ', 6)' if metric == 'revenue' else metric} AS {metric},
       CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
FROM by_{attr} QUALIFY rank <= {n}""")


# ---------------------------------------------------------------- sales
def _ranked_query(attr: str, metric: str, fn, n: int = 10):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, i = item_tables(spark, sf_dir)
        return rounded(fn(p, i, attr, n))
    return q


_LISTS = [
    # name, attribute, metric, operator, metric descending, key descending
    ("top_items_by_count", "item_name", "n_purchases", sales.top_by_count, True, False),
    ("bottom_items_by_count", "item_name", "n_purchases", sales.bottom_by_count, False, True),
    ("top_categories_by_count", "item_category", "n_purchases", sales.top_by_count, True, False),
    ("top_subcategories_by_count", "item_subcategory", "n_purchases", sales.top_by_count,
     True, False),
    ("bottom_subcategories_by_count", "item_subcategory", "n_purchases", sales.bottom_by_count,
     False, True),
    ("top_items_by_revenue", "item_name", "revenue", sales.top_by_revenue, True, False),
    ("bottom_items_by_revenue", "item_name", "revenue", sales.bottom_by_revenue, False, False),
    ("top_categories_by_revenue", "item_category", "revenue", sales.top_by_revenue, True, False),
    ("top_subcategories_by_revenue", "item_subcategory", "revenue", sales.top_by_revenue,
     True, False),
]
for _name, _attr, _metric, _fn, _md, _kd in _LISTS:
    register(_name, ranked_sql(_attr, _metric, 10, _md, _kd))(_ranked_query(_attr, _metric, _fn))


@register("revenue_by_category", with_(by_attr_sql("item_category")) + """
SELECT item_category, round(revenue, 6) AS revenue,
       round(revenue * 100.0 / sum(revenue) OVER (), 6) AS share_pct,
       CAST(row_number() OVER (ORDER BY revenue DESC, item_category) AS INTEGER) AS rank
FROM by_item_category""")
def revenue_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: A8 + A15, revenue per category with its share and rank."""
    p, i = item_tables(spark, sf_dir)
    top = sales.top_by_revenue(p, i, "item_category", 10)
    sh = sales.share(p, i, "item_category", "revenue").select("item_category", "share_pct")
    return rounded(top.join(sh, "item_category").select(
        "item_category", "revenue", "share_pct", "rank"))


@register("category_volume_share", with_(by_attr_sql("item_category")) + """
SELECT item_category, n_purchases,
       round(n_purchases * 100.0 / sum(n_purchases) OVER (), 6) AS share_pct
FROM by_item_category""")
def category_volume_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = item_tables(spark, sf_dir)
    return rounded(sales.share(p, i, "item_category", "n_purchases"))


@register("category_revenue_share", with_(by_attr_sql("item_category")) + """
SELECT item_category, round(revenue, 6) AS revenue,
       round(revenue * 100.0 / sum(revenue) OVER (), 6) AS share_pct
FROM by_item_category""")
def category_revenue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = item_tables(spark, sf_dir)
    return rounded(sales.share(p, i, "item_category", "revenue"))


_PER_CUSTOMER_SQL = """
per_customer AS (
  SELECT customer_id, CAST(sum(total_price) AS DOUBLE) / count(total_price) AS mean_spend
  FROM purchases WHERE customer_id IS NOT NULL GROUP BY customer_id
  HAVING count(total_price) > 0)"""


@register("customer_mean_spend", with_(_PER_CUSTOMER_SQL) + """
SELECT customer_id, round(mean_spend, 6) AS mean_spend FROM per_customer""")
def customer_mean_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, _ = tables(spark, sf_dir)
    return rounded(sales.customer_mean_spend(p))


_DIST_SQL = """
SELECT CAST(count(mean_spend) AS BIGINT) AS count, round(avg(mean_spend), 6) AS mean,
       round(stddev_samp(mean_spend), 6) AS std, round(min(mean_spend), 6) AS min,
       round(quantile_cont(mean_spend, 0.25), 6) AS p25,
       round(quantile_cont(mean_spend, 0.5), 6) AS p50,
       round(quantile_cont(mean_spend, 0.75), 6) AS p75,
       round(max(mean_spend), 6) AS max
FROM per_customer"""


@register("customer_spend_distribution", with_(_PER_CUSTOMER_SQL) + _DIST_SQL)
def customer_spend_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, _ = tables(spark, sf_dir)
    return rounded(sales.spend_distribution(p))


@register("spend_by_segment", with_() + """
SELECT c.segment, round(CAST(sum(p.total_price) AS DOUBLE) / count(p.total_price), 6)
       AS mean_spend
FROM purchases p LEFT JOIN customers c ON p.customer_id = c.customer_id
WHERE c.segment IS NOT NULL GROUP BY c.segment HAVING count(p.total_price) > 0""")
def spend_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _, c = tables(spark, sf_dir)
    return rounded(sales.spend_by_segment(p, c))


def _report_sql(priced: bool = True) -> str:
    attrs = ["item_name", "item_category", "item_subcategory"]
    sections = [
        ("top_selling_items", "item_name", "n_purchases", True, False),
        ("bottom_selling_items", "item_name", "n_purchases", False, True),
        ("top_selling_categories", "item_category", "n_purchases", True, False),
        ("top_selling_subcategories", "item_subcategory", "n_purchases", True, False),
        ("bottom_selling_subcategories", "item_subcategory", "n_purchases", False, True),
        ("revenue_top_items", "item_name", "revenue", True, False),
        ("revenue_bottom_items", "item_name", "revenue", False, False),
        ("revenue_top_categories", "item_category", "revenue", True, False),
        ("revenue_top_subcategories", "item_subcategory", "revenue", True, False),
    ]
    sel = []
    for section, attr, metric, md, kd in sections:
        if metric == "revenue" and not priced:
            name = "Item" + attr.removeprefix("item_").capitalize()
            sel.append(_message_sql(section, f"{name} or TotalPrice"))
            continue
        order = f"{metric} {'DESC' if md else 'ASC'}, {attr} {'DESC' if kd else 'ASC'}"
        sel.append(f"""
SELECT '{section}' AS section, CAST({attr} AS VARCHAR) AS key,
       round(CAST({metric} AS DOUBLE), 6) AS value,
       CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank,
       CAST(NULL AS VARCHAR) AS message
FROM by_{attr} QUALIFY rank <= 10""")
    if not priced:
        sel.append(_message_sql("customer_spending", "CustomerID or TotalPrice"))
        sel.append(_message_sql("customer_spending_by_segment", "CustomerSegment or TotalPrice"))
        return (with_(*[by_attr_sql(a) for a in attrs])
                + "\nUNION ALL".join(f"({s})" for s in sel))
    sel.append("""
SELECT 'customer_spending_per_customer', CAST(customer_id AS VARCHAR), round(mean_spend, 6),
       CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM per_customer""")
    sel.append("""
SELECT 'customer_spending_overall_average', CAST(NULL AS VARCHAR), round(avg(mean_spend), 6),
       CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR) FROM per_customer
HAVING count(*) > 0""")
    sel.append("""
SELECT 'customer_spending_distribution', k, round(v, 6), CAST(NULL AS INTEGER),
       CAST(NULL AS VARCHAR)
FROM (SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS k,
             unnest([CAST(count(mean_spend) AS DOUBLE), avg(mean_spend),
                     stddev_samp(mean_spend), min(mean_spend),
                     quantile_cont(mean_spend, 0.25), quantile_cont(mean_spend, 0.5),
                     quantile_cont(mean_spend, 0.75), max(mean_spend)]) AS v
      FROM per_customer HAVING count(*) > 0)""")
    sel.append("""
SELECT 'customer_spending_by_segment', c.segment,
       round(CAST(sum(p.total_price) AS DOUBLE) / count(p.total_price), 6),
       CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR)
FROM purchases p LEFT JOIN customers c ON p.customer_id = c.customer_id
WHERE c.segment IS NOT NULL GROUP BY c.segment HAVING count(p.total_price) > 0""")
    return with_(*[by_attr_sql(a) for a in attrs], _PER_CUSTOMER_SQL) + \
        "\nUNION ALL".join(f"({s})" for s in sel)


def _message_sql(section: str, what: str) -> str:
    return f"""
SELECT '{section}' AS section, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS value,
       CAST(NULL AS INTEGER) AS rank, 'Cannot be determined (missing {what} data)' AS message"""


@register("sales_report_unpriced", _report_sql(priced=False))
def sales_report_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 + A34: the same purchases without any price."""
    p, i, c = tables(spark, sf_dir)
    return sales_report.sales_report(
        p.withColumn("total_price", F.lit(None).cast("decimal(18,2)")), i, c)


@register("sales_report", _report_sql())
def sales_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of the report in long form."""
    p, i, c = tables(spark, sf_dir)
    return rounded(sales_report.sales_report(p, i, c))


def _dashboard_sql() -> str:
    cuts = [
        ("top_items", "item_name", "n_purchases", True, False, 5),
        ("bottom_items", "item_name", "n_purchases", False, True, 5),
        ("top_subcategories", "item_subcategory", "n_purchases", True, False, 5),
        ("top_items_revenue", "item_name", "revenue", True, False, 5),
        ("bottom_items_revenue", "item_name", "revenue", False, False, 5),
        ("top_subcategories_revenue", "item_subcategory", "revenue", True, False, 5),
        ("leading_subcategory_revenue", "item_subcategory", "revenue", True, False, 1),
    ]
    sel = []
    for section, attr, metric, md, kd, n in cuts:
        order = f"{metric} {'DESC' if md else 'ASC'}, {attr} {'DESC' if kd else 'ASC'}"
        sel.append(f"""
SELECT '{section}' AS section, CAST({attr} AS VARCHAR) AS key,
       round(CAST({metric} AS DOUBLE), 6) AS value,
       CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
FROM by_{attr} QUALIFY rank <= {n}""")
    return with_(by_attr_sql("item_name"), by_attr_sql("item_subcategory")) + \
        "\nUNION ALL".join(f"({s})" for s in sel)


@register("sales_dashboard", _dashboard_sql())
def sales_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    p, i = item_tables(spark, sf_dir)
    return rounded(sales_report.dashboard(p, i))


# ---------------------------------------------------------------- features
from basketry.operators import features as feat  # noqa: E402
from basketry.operators import segments as seg  # noqa: E402

REF = wh.REFERENCE_DATE
EPOCH = wh.EPOCH
#: Five centres of the scaled features, in the order of FEATURES.
CENTRES = (
    (-0.5, 1.0, 1.5, 0.0, 0.5, -0.5, 0.5, -0.5, 0.5, 0.0, 0.0),
    (0.0, 0.0, 0.0, -1.0, 1.0, -1.0, 0.0, 0.0, 0.0, 0.5, -0.5),
    (0.0, 0.0, 0.0, 1.0, -1.0, 1.0, 0.0, 0.0, 0.0, -0.5, 0.5),
    (1.5, -1.0, -1.0, 0.0, 0.0, 0.0, -0.5, 1.0, -0.5, 0.0, 0.0),
    (0.5, -0.5, -0.5, 0.5, 0.5, -0.5, 1.0, 0.5, 0.0, -1.0, 1.0),
)

_AGG_SQL = f"""
agg AS (
  SELECT p.customer_id, max(p.purchase_date) AS _last, min(p.purchase_date) AS _first,
         count(p.purchase_date) AS _n_dated, count(p.item_id) AS frequency,
         CAST(coalesce(sum(p.total_price), 0) AS DOUBLE) AS monetary_value,
         count(CASE WHEN i.item_category = 'Service' THEN 1 END) AS _n_service,
         count(CASE WHEN i.item_category = 'Product' THEN 1 END) AS _n_product,
         count(i.item_category) AS _n_cat
  FROM purchases p LEFT JOIN items i ON p.item_id = i.item_id
  WHERE p.customer_id IS NOT NULL GROUP BY p.customer_id),
rfm AS (
  SELECT customer_id, CAST(date_diff('day', _last, DATE '{REF}') AS BIGINT) AS recency,
         CAST(frequency AS BIGINT) AS frequency, monetary_value,
         monetary_value / NULLIF(CAST(frequency AS DOUBLE), 0) AS aov,
         CASE WHEN _n_dated > 1
              THEN CAST(date_diff('day', _first, _last) AS DOUBLE) / (_n_dated - 1)
         END AS avg_time_between_purchases,
         CAST(_n_service AS DOUBLE) / NULLIF(CAST(_n_cat AS DOUBLE), 0) AS service_ratio,
         CAST(_n_product AS DOUBLE) / NULLIF(CAST(_n_cat AS DOUBLE), 0) AS product_ratio
  FROM agg)"""

_STREAK_SQL = f"""
days AS (
  SELECT DISTINCT customer_id, date_diff('day', DATE '{EPOCH}', purchase_date) AS day
  FROM purchases WHERE customer_id IS NOT NULL AND purchase_date IS NOT NULL),
islands AS (
  SELECT customer_id, day - row_number() OVER (PARTITION BY customer_id ORDER BY day) AS island
  FROM days),
streak AS (
  SELECT customer_id, CAST(max(run) AS BIGINT) AS longest_purchase_streak
  FROM (SELECT customer_id, island, count(*) AS run FROM islands GROUP BY customer_id, island)
  GROUP BY customer_id)"""

_FEAT_SQL = _AGG_SQL + "," + _STREAK_SQL + """,
feat AS (
  SELECT r.customer_id, r.recency, r.frequency, r.monetary_value,
         coalesce(CAST(c.age AS DOUBLE), 0.0) AS age,
         CAST(coalesce(CAST(c.gender = 'F' AS INTEGER), 0) AS INTEGER) AS gender_f,
         CAST(coalesce(CAST(c.gender = 'M' AS INTEGER), 0) AS INTEGER) AS gender_m,
         coalesce(r.aov, 0.0) AS aov,
         coalesce(r.avg_time_between_purchases,
                  (SELECT max(avg_time_between_purchases) FROM rfm))
           AS avg_time_between_purchases,
         CAST(coalesce(s.longest_purchase_streak, 0) AS BIGINT) AS longest_purchase_streak,
         coalesce(r.service_ratio, 0.0) AS service_ratio,
         coalesce(r.product_ratio, 0.0) AS product_ratio
  FROM rfm r LEFT JOIN customers c ON r.customer_id = c.customer_id
  LEFT JOIN streak s ON r.customer_id = s.customer_id)"""

_F = feat.FEATURES
_SCALED_SQL = _FEAT_SQL + ",\nscaled AS (\n  SELECT customer_id, " + ",\n    ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN (CAST({c} AS DOUBLE) - avg({c}) OVER ()) "
    f"/ stddev_pop({c}) OVER () ELSE 0.0 END AS {c}" for c in _F) + "\n  FROM feat)"

_CENTRES_SQL = ", ".join(
    "(" + ", ".join([f"CAST({j} AS INTEGER)", *[f"CAST({v} AS DOUBLE)" for v in c]]) + ")"
    for j, c in enumerate(CENTRES))
_DIST_EXPR = " + ".join(f"(s.{c} - c.{c}) * (s.{c} - c.{c})" for c in _F)
_ASSIGN_SQL = _SCALED_SQL + f""",
sr AS (SELECT customer_id, {', '.join(f'round({c}, 6) AS {c}' for c in _F)} FROM scaled),
cen AS (SELECT * FROM (VALUES {_CENTRES_SQL}) AS t(cluster, {', '.join(_F)})),
dist AS (SELECT s.customer_id, c.cluster, {_DIST_EXPR} AS distance FROM sr s CROSS JOIN cen c),
assigned AS (
  SELECT customer_id, cluster, distance FROM dist
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY distance, cluster) = 1)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i, c = tables(spark, sf_dir)
    return feat.customer_features(p, i, c, ref_date=REF, epoch=EPOCH)


@register("customer_rfm", with_(_AGG_SQL) + """
SELECT customer_id, recency, frequency, round(monetary_value, 6) AS monetary_value,
       round(aov, 6) AS aov FROM rfm""")
def customer_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + A18."""
    p, _, _ = tables(spark, sf_dir)
    return rounded(feat.rfm(p, REF))


@register("purchase_day_gaps", with_() + """
SELECT customer_id, purchase_date, n_rows,
       CAST(date_diff('day', lag(purchase_date) OVER (PARTITION BY customer_id
            ORDER BY purchase_date), purchase_date) AS BIGINT) AS gap_days
FROM (SELECT customer_id, purchase_date, CAST(count(*) AS BIGINT) AS n_rows FROM purchases
      WHERE customer_id IS NOT NULL AND purchase_date IS NOT NULL
      GROUP BY customer_id, purchase_date)""")
def purchase_day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + T1."""
    p, _, _ = tables(spark, sf_dir)
    return feat.daily_gaps(p)


@register("mean_purchase_gap", with_(_AGG_SQL) + """
SELECT customer_id, round(avg_time_between_purchases, 6) AS avg_time_between_purchases
FROM rfm""")
def mean_purchase_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    p, i, _ = tables(spark, sf_dir)
    return rounded(feat.customer_aggregates(p, i, REF).select(
        "customer_id", "avg_time_between_purchases"))


@register("purchase_streaks", with_(_STREAK_SQL) + """
SELECT customer_id, longest_purchase_streak FROM streak""")
def purchase_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 + W2 + X3 over order days."""
    p, _, _ = tables(spark, sf_dir)
    return feat.longest_streaks(p, EPOCH)


@register("event_streaks", """
WITH days AS (
  SELECT DISTINCT user_id AS customer_id,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day
  FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL),
islands AS (
  SELECT customer_id, day - row_number() OVER (PARTITION BY customer_id ORDER BY day) AS island
  FROM days)
SELECT customer_id, CAST(max(run) AS BIGINT) AS longest_purchase_streak
FROM (SELECT customer_id, island, count(*) AS run FROM islands GROUP BY customer_id, island)
GROUP BY customer_id""")
def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 + W2 over purchase events (long streaks)."""
    return feat.longest_streaks(wh.event_purchases(spark, sf_dir), "2024-01-01")


@register("category_mix", with_(_AGG_SQL) + """
SELECT customer_id, round(service_ratio, 6) AS service_ratio,
       round(product_ratio, 6) AS product_ratio FROM rfm""")
def category_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    p, i, _ = tables(spark, sf_dir)
    return rounded(feat.customer_aggregates(p, i, REF).select(
        "customer_id", "service_ratio", "product_ratio"))


@register("customer_demographics", with_() + """
SELECT customer_id, age,
       CAST(coalesce(CAST(gender = 'F' AS INTEGER), 0) AS INTEGER) AS gender_f,
       CAST(coalesce(CAST(gender = 'M' AS INTEGER), 0) AS INTEGER) AS gender_m
FROM customers WHERE customer_id IN (SELECT customer_id FROM purchases)""")
def customer_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 + P7: demographics of purchasing customers."""
    p, _, c = tables(spark, sf_dir)
    buyers = c.join(p.select("customer_id"), "customer_id", "left_semi")
    return feat.demographics(buyers)


@register("customer_features", with_(_FEAT_SQL) + """
SELECT customer_id, recency, frequency, round(monetary_value, 6) AS monetary_value, age,
       gender_f, gender_m, round(aov, 6) AS aov,
       round(avg_time_between_purchases, 6) AS avg_time_between_purchases,
       longest_purchase_streak, round(service_ratio, 6) AS service_ratio,
       round(product_ratio, 6) AS product_ratio
FROM feat""")
def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + P17."""
    return rounded(_features(spark, sf_dir))


@register("standardized_features", with_(_SCALED_SQL) + "\nSELECT customer_id, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _F) + " FROM scaled")
def standardized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    from basketry.session import materialize
    return rounded(feat.standardize(materialize(_features(spark, sf_dir))))


def _fixed(spark: SparkSession, sf_dir: str):
    """Features (materialised), their scaled form, the literal centres and the
    feature rows with cluster and distance (a projection of the features). The
    coordinates are rounded to 6 places, as in the SQL."""
    from basketry.session import materialize
    f = materialize(_features(spark, sf_dir))
    ex = feat.standardized_exprs(f)
    s = feat.standardize(f, exprs=ex)
    centres = [list(c) for c in CENTRES]
    a = seg.assign(f, centres, places=6, keep=f.columns, exprs=ex)
    return f, s, centres, a


@register("segment_assignment", with_(_ASSIGN_SQL) + """
SELECT customer_id, cluster, round(distance, 6) AS distance FROM assigned""")
def segment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5 (+A33 per customer) under fixed centres."""
    _, _, _, a = _fixed(spark, sf_dir)
    return rounded(a.select("customer_id", "cluster", "distance"))


_P = feat.PROFILE


@register("segment_inertia", with_(_ASSIGN_SQL) + """
SELECT round(sum(distance), 6) AS inertia FROM assigned""")
def segment_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33 under fixed centres."""
    _, _, _, a = _fixed(spark, sf_dir)
    return rounded(a.agg(F.sum("distance").alias("inertia")))


@register("segment_profile_weighted", with_(_ASSIGN_SQL) + "\nSELECT a.cluster, " + ", ".join(
    f"round_even(sum(CAST(f.{c} AS DOUBLE) * f.frequency) / sum(CAST(f.frequency AS DOUBLE)), 2) "
    f"AS {c}"
    for c in _P) + " FROM feat f JOIN assigned a ON f.customer_id = a.customer_id GROUP BY a.cluster")
def segment_profile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 + J5 under fixed centres."""
    _, _, _, a = _fixed(spark, sf_dir)
    return seg.profile_weighted(a)


_PG = _P + ["gender_f", "gender_m"]


@register("segment_profile", with_(_ASSIGN_SQL) + "\nSELECT a.cluster, " + ", ".join(
    f"round(avg(CAST(f.{c} AS DOUBLE)), 6) AS {c}" for c in _PG)
    + " FROM feat f JOIN assigned a ON f.customer_id = a.customer_id GROUP BY a.cluster")
def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23 under fixed centres."""
    _, _, _, a = _fixed(spark, sf_dir)
    return rounded(seg.profile(a))


@register("segment_sizes", with_(_ASSIGN_SQL) + """
SELECT a.cluster, CAST(count(*) AS BIGINT) AS n_customers,
       CAST(sum(f.frequency) AS BIGINT) AS n_rows
FROM feat f JOIN assigned a ON f.customer_id = a.customer_id GROUP BY a.cluster""")
def segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 under fixed centres."""
    _, _, _, a = _fixed(spark, sf_dir)
    return seg.sizes(a)


@register("segment_centres", with_(_ASSIGN_SQL) + ",\nst AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, "
    f"stddev_pop(CAST({c} AS DOUBLE)) AS std FROM feat" for c in _F) + "),\ncl AS (" +
    " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, {c} AS scaled FROM cen" for c in _F)
    + ")\nSELECT cl.cluster, cl.feature, round(cl.scaled * st.std + st.mean, 6) AS value "
    "FROM cl JOIN st ON cl.feature = st.feature")
def segment_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 under fixed centres."""
    f, _, centres, _ = _fixed(spark, sf_dir)
    return rounded(seg.centres_original(centres, feat.standardization_stats(f)))


def _projection_sql() -> str:
    views = [(f"{x}|{y}", x, y, None) for x, y in seg.PAIRS] + [("|".join(seg.TRIPLE),)
                                                               + seg.TRIPLE]
    sel = []
    for name, x, y, z in views:
        zz = f"round(CAST(f.{z} AS DOUBLE), 6)" if z else "CAST(NULL AS DOUBLE)"
        sel.append(f"SELECT f.customer_id, a.cluster, '{name}' AS view, "
                   f"round(CAST(f.{x} AS DOUBLE), 6) AS x, round(CAST(f.{y} AS DOUBLE), 6) AS y, "
                   f"{zz} AS z FROM feat f JOIN assigned a ON f.customer_id = a.customer_id")
    return with_(_ASSIGN_SQL) + "\n" + "\nUNION ALL ".join(sel)


@register("segment_projections", _projection_sql())
def segment_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 under fixed centres."""
    _, _, _, a = _fixed(spark, sf_dir)
    return rounded(seg.projections(a))


@register("segment_labels_on_purchases", with_(_ASSIGN_SQL) + """
SELECT p.customer_id, p.item_id, p.purchase_date, CAST(p.total_price AS DOUBLE) AS total_price,
       a.cluster, 'Cluster ' || CAST(a.cluster AS VARCHAR) AS cluster_label
FROM purchases p LEFT JOIN assigned a ON p.customer_id = a.customer_id""")
def segment_labels_on_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22 + J4 under fixed centres."""
    p, _, _ = tables(spark, sf_dir)
    _, _, _, a = _fixed(spark, sf_dir)
    out = seg.attach(p, seg.label_clusters(a.select("customer_id", "cluster")))
    return out.select("customer_id", "item_id", "purchase_date",
                      F.col("total_price").cast("double").alias("total_price"),
                      "cluster", "cluster_label")


# ---------------------------------------------------------------- interactions
from basketry.operators import interactions as inter  # noqa: E402
from basketry.operators import recommend as rec  # noqa: E402
from basketry.settings import DEFAULTS  # noqa: E402

K = DEFAULTS.top_k
MIN_ITEMS = DEFAULTS.min_interactions
MONTHS = DEFAULTS.test_period_months

_MATRIX_SQL = f"""
matrix AS (
  SELECT customer_id, item_id, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity
  FROM purchases WHERE customer_id IS NOT NULL AND item_id IS NOT NULL
  GROUP BY customer_id, item_id),
active AS (
  SELECT customer_id FROM matrix GROUP BY customer_id
  HAVING count(CASE WHEN quantity > 0 THEN 1 END) >= {MIN_ITEMS}),
amatrix AS (SELECT * FROM matrix WHERE customer_id IN (SELECT customer_id FROM active)),
pop AS (
  SELECT c.item_id, CAST(coalesce(p.popularity, 0) AS BIGINT) AS popularity
  FROM (SELECT DISTINCT item_id FROM matrix) c
  LEFT JOIN (SELECT item_id, sum(quantity) AS popularity FROM amatrix GROUP BY item_id) p
    ON c.item_id = p.item_id),
ranked AS (
  SELECT item_id, popularity,
         CAST(row_number() OVER (ORDER BY popularity DESC, item_id) AS BIGINT) AS rank
  FROM pop),
cut AS (SELECT CAST(max(purchase_date) - INTERVAL {MONTHS} MONTH AS DATE) AS cut FROM purchases),
ranges AS (
  SELECT i.item_id,
         CAST(CASE WHEN coalesce(s._n, 0) >= (SELECT count(*) FROM active) THEN s._min
                   ELSE least(coalesce(s._min, 0), 0) END AS DOUBLE) AS data_min,
         CAST(CASE WHEN coalesce(s._n, 0) >= (SELECT count(*) FROM active) THEN s._max
                   ELSE greatest(coalesce(s._max, 0), 0) END AS DOUBLE) AS data_max
  FROM items i LEFT JOIN (SELECT item_id, count(*) AS _n, min(quantity) AS _min,
                                 max(quantity) AS _max FROM amatrix GROUP BY item_id) s
    ON i.item_id = s.item_id)"""


def _matrix(spark: SparkSession, sf_dir: str):
    """Purchases, items, customers, the full matrix and the active-user matrix.
    The matrix is read several times downstream (activity, popularity,
    history masks), so it is reduced from the fact table once."""
    from basketry.session import materialize
    p, i, c = tables(spark, sf_dir)
    m = materialize(inter.user_item_matrix(p))
    am = m.join(inter.active_users(m, MIN_ITEMS), "customer_id", "left_semi")
    return p, i, c, m, am


@register("user_item_matrix", with_(_MATRIX_SQL) + "\nSELECT * FROM matrix")
def user_item_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    p, _, _ = tables(spark, sf_dir)
    return inter.user_item_matrix(p)


@register("items_per_user", with_(_MATRIX_SQL) + """
SELECT customer_id, CAST(count(CASE WHEN quantity > 0 THEN 1 END) AS BIGINT) AS n_items
FROM matrix GROUP BY customer_id""")
def items_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, from sets of item words."""
    from basketry.operators import itemsets
    p, _, _ = tables(spark, sf_dir)
    return itemsets.items_per_user(inter.user_item_matrix(p))


@register("active_users", with_(_MATRIX_SQL) + "\nSELECT customer_id FROM active")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    p, _, _ = tables(spark, sf_dir)
    return inter.active_users(inter.user_item_matrix(p), MIN_ITEMS)


@register("interactions", with_(_MATRIX_SQL) + "\nSELECT * FROM amatrix")
def interactions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3."""
    p, _, _ = tables(spark, sf_dir)
    return inter.interactions(p, MIN_ITEMS)


@register("item_popularity", with_(_MATRIX_SQL) + f"""
SELECT item_id, popularity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {K}""")
def item_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27 (top-k)."""
    _, _, _, m, am = _matrix(spark, sf_dir)
    return rec.top_popular(am, m, K).withColumn("rank", F.col("rank").cast("int"))


@register("item_popularity_ranked", with_(_MATRIX_SQL) + "\nSELECT item_id, popularity, rank "
          "FROM ranked")
def item_popularity_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27 (full ranking, distributed global row number)."""
    _, _, _, m, am = _matrix(spark, sf_dir)
    return rec.ranked_popularity(am, m)


@register("item_ranges", with_(_MATRIX_SQL) + """
SELECT item_id, data_min, data_max,
       CASE WHEN data_max - data_min = 0 THEN 1.0 ELSE data_max - data_min END AS scale
FROM ranges""")
def item_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28 + V11."""
    _, i, _, _, am = _matrix(spark, sf_dir)
    return inter.item_ranges(am, i)


@register("scaled_interactions", with_(_MATRIX_SQL) + """
SELECT m.customer_id, m.item_id,
       round((m.quantity - r.data_min) / CASE WHEN r.data_max - r.data_min = 0 THEN 1.0
             ELSE r.data_max - r.data_min END, 6) AS value
FROM amatrix m JOIN ranges r ON m.item_id = r.item_id""")
def scaled_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4."""
    _, i, _, _, am = _matrix(spark, sf_dir)
    return rounded(inter.minmax_scale(am, inter.item_ranges(am, i)))


@register("user_index", with_() + """
SELECT customer_id, CAST(dense_rank() OVER (ORDER BY customer_id) - 1 AS BIGINT) AS user_idx
FROM (SELECT DISTINCT customer_id FROM customers WHERE customer_id IS NOT NULL)""")
def user_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 over customers."""
    return inter.dense_index(wh.customers(spark, sf_dir), "customer_id", "user_idx")


@register("item_index", with_() + """
SELECT item_id, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_idx
FROM (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL)""")
def item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 over the catalogue."""
    return inter.dense_index(wh.items(spark, sf_dir), "item_id", "item_idx")


@register("test_cutoff", with_(_MATRIX_SQL) + """
SELECT max(purchase_date) AS latest_date, (SELECT cut FROM cut) AS cutoff_date FROM purchases""")
def test_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    p, _, _ = tables(spark, sf_dir)
    return inter.test_cutoff(p, MONTHS)


@register("temporal_split", with_(_MATRIX_SQL) + """
SELECT customer_id, bool_or(purchase_date < (SELECT cut FROM cut)) AS in_train,
       bool_or(purchase_date >= (SELECT cut FROM cut)) AS in_test
FROM purchases WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8 + A30 + V18."""
    p, _, _ = tables(spark, sf_dir)
    return inter.temporal_split(p, MONTHS)


_HIST_SQL = """
hist AS (
  SELECT m.customer_id, string_agg(i.item_name, '|' ORDER BY i.item_name) AS purchase_history
  FROM amatrix m JOIN items i ON m.item_id = i.item_id
  WHERE m.quantity > 0 GROUP BY m.customer_id)"""


@register("purchase_history", with_(_MATRIX_SQL, _HIST_SQL) + """
SELECT c.customer_id, coalesce(h.purchase_history, '') AS purchase_history
FROM customers c LEFT JOIN hist h ON c.customer_id = h.customer_id""")
def purchase_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31 (names joined by '|', sorted; empty under the activity threshold)."""
    from basketry.plans import serving
    p, i, c, m, am = _matrix(spark, sf_dir)
    return serving.history_strings(c.select("customer_id"), am, i)


@register("purchase_history_rows", with_(_MATRIX_SQL) + """
SELECT m.customer_id, m.item_id, i.item_name
FROM amatrix m LEFT JOIN items i ON m.item_id = i.item_id WHERE m.quantity > 0""")
def purchase_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31 in long form: one row per customer and item bought."""
    _, i, _, _, am = _matrix(spark, sf_dir)
    return inter.history(am, i)


_RECS_SQL = f"""
recs AS (
  SELECT customer_id, item_id, rn AS rank FROM (
    SELECT c.customer_id, r.item_id,
           CAST(row_number() OVER (PARTITION BY c.customer_id ORDER BY r.rank) AS INTEGER) AS rn
    FROM customers c CROSS JOIN ranked r
    WHERE NOT EXISTS (SELECT 1 FROM matrix m WHERE m.customer_id = c.customer_id
                      AND m.item_id = r.item_id AND m.quantity > 0)
    QUALIFY rn <= {K}))"""


@register("recommend_popular", with_(_MATRIX_SQL, _RECS_SQL) + """
SELECT r.customer_id, r.rank, r.item_id, i.item_name
FROM recs r LEFT JOIN items i ON r.item_id = i.item_id""")
def recommend_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13/R14 with the popularity score + W3 + W5 + J6 + J7 + J8."""
    p, i, c, m, am = _matrix(spark, sf_dir)
    recs = rec.recommend_unseen_by_rank(c.select("customer_id"), m,
                                        rec.ranked_popularity(am, m), K)
    return rec.with_names(recs, i).select("customer_id", "rank", "item_id", "item_name")


@register("recommend_batch", with_(_MATRIX_SQL, _RECS_SQL, _HIST_SQL) + """
SELECT c.customer_id, coalesce(h.purchase_history, '') AS purchase_history,
       coalesce(x.recommendations, '') AS recommendations
FROM customers c LEFT JOIN hist h ON c.customer_id = h.customer_id
LEFT JOIN (SELECT r.customer_id, string_agg(i.item_name, '|' ORDER BY r.rank) AS recommendations
           FROM recs r LEFT JOIN items i ON r.item_id = i.item_id GROUP BY r.customer_id) x
  ON c.customer_id = x.customer_id""")
def recommend_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and recommendations for every requested customer."""
    from basketry.plans import serving
    p, i, c, m, am = _matrix(spark, sf_dir)
    recs = rec.recommend_unseen_by_rank(c.select("customer_id"), m,
                                        rec.ranked_popularity(am, m), K)
    return serving.batch_strings(c.select("customer_id"), am, rec.with_names(recs, i), i)


# Customers with fewer items than this count as inactive here, so that lists for
# inactive customers are among the answers; suppliers' keys make up requests of
# unknown customers.
_BUSY = 30
_BUSY_SQL = _MATRIX_SQL.replace(f">= {MIN_ITEMS})", f">= {_BUSY})")
_REQUESTS_SQL = """
requests AS (SELECT customer_id FROM customers
             UNION SELECT s_suppkey + 100000000 FROM supplier)"""


def _busy(spark: SparkSession, sf_dir: str):
    """Matrix, its part of customers with many items, and the requests."""
    from basketry.session import materialize
    m = materialize(inter.user_item_matrix(wh.purchases(spark, sf_dir)))
    am = materialize(m.join(inter.active_users(m, _BUSY), "customer_id", "left_semi"))
    unknown = wh.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 100000000).alias("customer_id"))
    requests = wh.customers(spark, sf_dir).select("customer_id").union(unknown).distinct()
    return m, am, requests


@register("recommend_requests", "WITH " + ",".join((
    BASE, _BUSY_SQL, _REQUESTS_SQL, _RECS_SQL.replace("FROM customers c", "FROM requests c"))) + """
SELECT customer_id, rank, item_id FROM recs""")
def recommend_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13/R14 + J8: popularity for active, inactive and unknown customers."""
    m, am, requests = _busy(spark, sf_dir)
    return rec.recommend_unseen_by_rank(requests, m, rec.ranked_popularity(am, m), K)


# Vectors given by the keys, so that scores are whole numbers on both sides.
_USER_VECTOR = ("{0} % 7", "{0} % 11", "{0} % 3 - 1")
_ITEM_VECTOR = ("{0} % 5 - 2", "{0} % 13", "{0} % 17")
_DOT = " + ".join(f"({u.format('a.customer_id')}) * ({v.format('b.item_id')})"
                  for u, v in zip(_USER_VECTOR, _ITEM_VECTOR))


def _given_sql(requests: str, mask: bool) -> str:
    """Lists of K items: the products for active requesters, then popularity."""
    unseen = """
    WHERE NOT EXISTS (SELECT 1 FROM matrix m WHERE m.customer_id = a.customer_id
                      AND m.item_id = b.item_id AND m.quantity > 0)""" if mask else ""
    also = "" if not mask else """
                      OR EXISTS (SELECT 1 FROM matrix m WHERE m.customer_id = a.customer_id
                                 AND m.item_id = b.item_id AND m.quantity > 0)"""
    return f"""
asked AS (SELECT DISTINCT customer_id FROM {requests}),
scored AS (
  SELECT a.customer_id, b.item_id, CAST({_DOT} AS DOUBLE) AS score,
         CAST(row_number() OVER (PARTITION BY a.customer_id
              ORDER BY {_DOT} DESC, b.item_id) AS INTEGER) AS rank
  FROM (SELECT customer_id FROM asked WHERE customer_id IN (SELECT customer_id FROM active)) a
  CROSS JOIN (SELECT DISTINCT item_id FROM amatrix) b{unseen}
  QUALIFY rank <= {K}),
have AS (SELECT a.customer_id, CAST(count(s.item_id) AS INTEGER) AS n FROM asked a
         LEFT JOIN scored s ON a.customer_id = s.customer_id GROUP BY a.customer_id),
filled AS (
  SELECT a.customer_id, b.item_id, CAST(NULL AS DOUBLE) AS score, a.n
         + CAST(row_number() OVER (PARTITION BY a.customer_id ORDER BY b.pos) AS INTEGER) AS rank
  FROM have a CROSS JOIN (SELECT item_id, rank AS pos FROM ranked) b
  WHERE a.n < {K} AND NOT (EXISTS (SELECT 1 FROM scored s WHERE s.customer_id = a.customer_id
                                   AND s.item_id = b.item_id){also})
  QUALIFY rank <= {K}),
given AS (SELECT customer_id, rank, item_id, score FROM scored
          UNION ALL SELECT customer_id, rank, item_id, score FROM filled)"""


def _given_lists(spark: SparkSession, m: DataFrame, am: DataFrame, requests: DataFrame,
                 exclude: bool) -> DataFrame:
    from basketry.plans import training

    def vector(key: str, parts) -> DataFrame:
        return F.array(*[F.expr(p.format(key)).cast("float") for p in parts]).alias("features")

    users = am.select("customer_id").distinct()
    user_index = users.select("customer_id", F.col("customer_id").alias("user_idx"))
    wanted = user_index.join(requests.select("customer_id").distinct(), "customer_id",
                             "left_semi")
    items = am.select("item_id").distinct()
    return training.recommend_by_factors(
        requests, wanted.select("user_idx", vector("user_idx", _USER_VECTOR)),
        items.select(F.col("item_id").alias("id"), vector("item_id", _ITEM_VECTOR)),
        user_index, items.select("item_id", F.col("item_id").alias("item_idx")), am, m, None, K,
        exclude)


@register("recommend_given_factors", "WITH " + ",".join((
    BASE, _BUSY_SQL, _REQUESTS_SQL, _given_sql("requests", True))) + """
SELECT customer_id, rank, item_id, score FROM given""")
def recommend_given_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12-R14 + W3: lists by given vectors, history masked, popularity for
    requesters without a vector and for short lists."""
    m, am, requests = _busy(spark, sf_dir)
    return _given_lists(spark, m, am, requests, True)


_GIVEN_EVAL = """
actual AS (
  SELECT DISTINCT customer_id, item_id FROM purchases
  WHERE purchase_date >= (SELECT cut FROM cut) AND customer_id IS NOT NULL
    AND item_id IS NOT NULL)"""


@register("evaluation_given_factors", "WITH " + ",".join((
    BASE, _BUSY_SQL, _GIVEN_EVAL, _given_sql("actual", False))) + f"""
SELECT a.customer_id, round(CAST(count(g.item_id) AS DOUBLE) / {float(K)}, 6) AS precision,
       round(CAST(count(g.item_id) AS DOUBLE) / count(*), 6) AS recall
FROM actual a LEFT JOIN given g ON a.customer_id = g.customer_id AND a.item_id = g.item_id
GROUP BY a.customer_id""")
def evaluation_given_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R16 + X1 + W4: precision and recall of every test customer's own list, by
    the overlap of item sets."""
    from basketry.operators import itemsets
    m, am, _ = _busy(spark, sf_dir)
    p = wh.purchases(spark, sf_dir)
    actual = rec.actual_after(p, _cut(p))
    lists = _given_lists(spark, m, am, actual.select("customer_id"), False)
    return rounded(itemsets.precision_recall(lists, actual, K))


def _cut(p: DataFrame):
    from basketry.functions.columns import scalar
    return scalar(p.select(F.add_months(F.max("purchase_date"), -MONTHS)))


_EVAL_SQL = f"""
actual AS (
  SELECT DISTINCT customer_id, item_id FROM purchases
  WHERE purchase_date >= (SELECT cut FROM cut) AND customer_id IS NOT NULL
    AND item_id IS NOT NULL),
per AS (
  SELECT a.customer_id, count(t.item_id) AS hits, count(*) AS n
  FROM actual a LEFT JOIN (SELECT item_id FROM ranked WHERE rank <= {K}) t
    ON a.item_id = t.item_id
  GROUP BY a.customer_id),
pr AS (
  SELECT customer_id, CAST(hits AS DOUBLE) / {float(K)} AS precision,
         CAST(hits AS DOUBLE) / n AS recall FROM per)"""


@register("evaluation_per_customer", with_(_MATRIX_SQL, _EVAL_SQL) + """
SELECT customer_id, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr""")
def evaluation_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R16 + X1 with the popularity list (W4: no exclusion)."""
    p, i, c, m, am = _matrix(spark, sf_dir)
    cut = _cut(p)
    per = rec.precision_recall_shared(rec.top_popular(am, m, K), rec.actual_after(p, cut), K)
    return rounded(per)


@register("evaluation_summary", with_(_MATRIX_SQL, _EVAL_SQL) + """
SELECT CAST(count(*) AS BIGINT) AS n_customers,
       round(coalesce(avg(precision), 0.0), 6) AS mean_precision,
       round(coalesce(avg(recall), 0.0), 6) AS mean_recall FROM pr""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17 + A32 with the popularity list."""
    p, i, c, m, am = _matrix(spark, sf_dir)
    cut = _cut(p)
    per = rec.precision_recall_shared(rec.top_popular(am, m, K), rec.actual_after(p, cut), K)
    return rounded(rec.summarize(per))


# ---------------------------------------------------------------- model-based (rows checks)
@register("single_cluster_inertia", with_(_SCALED_SQL) + "\nSELECT round(" + " + ".join(
    f"sum({c} * {c})" for c in _F) + ", 3) AS inertia FROM scaled")
def single_cluster_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + A33 for k = 1, where the centre is the mean."""
    from basketry.session import materialize
    s = feat.standardize(materialize(_features(spark, sf_dir)))
    cost, _ = seg.fit_many(s, feat.FEATURES, [(1, DEFAULTS.seed)], DEFAULTS.fit_max_iter)[0]
    return spark.createDataFrame([(round(cost, 3),)], "inertia double")


@register("kmeans_segments")
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M5 + M6 + M7 + P22: best of 10 seeded K-means fits, k = 5."""
    from basketry.plans import segmentation
    p, i, c = tables(spark, sf_dir)
    res = segmentation.segment_customers(p, i, c, DEFAULTS.n_clusters, ref_date=REF, epoch=EPOCH)
    return rounded(res.assigned.select("customer_id", "cluster", "cluster_label", "distance"))


@register("elbow_series")
def elbow_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + A33: inertia for k = 1..20, 10 restarts each, 500 iterations."""
    from basketry.session import materialize
    s = feat.standardize(materialize(_features(spark, sf_dir)))
    return seg.elbow(s, DEFAULTS.max_clusters, DEFAULTS.seed, DEFAULTS.n_init,
                     DEFAULTS.elbow_max_iter)


@register("recommend_latent")
def recommend_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent model scores with history masked; popularity fallback."""
    from basketry.plans import training
    p, i, c = tables(spark, sf_dir)
    t = training.train(p, i, c)
    return rounded(training.recommend(t, c.select("customer_id"), i, K))


@register("evaluation_latent")
def evaluation_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17 with the latent model: mean precision@5 and recall@5 over test customers."""
    from basketry.plans import training
    p, i, c = tables(spark, sf_dir)
    t = training.train(p, i, c)
    return rounded(rec.summarize(training.evaluate(t, p, K)))


# ---------------------------------------------------------------- linear reconstruction
from basketry.operators import reconstruct as recon  # noqa: E402

# Directions given by the item keys, in whole numbers.
_DIRECTIONS = ("{0} % 5 - 2", "{0} % 7 - 3", "{0} % 3 - 1", "{0} % 11 - 5")
_WIDTH = len(_DIRECTIONS)
_GIVEN_V_SQL = "\n" + f"""
scaled AS (
  SELECT a.customer_id, a.item_id, r.data_min, (r.data_max - r.data_min)
         + CASE WHEN r.data_max = r.data_min THEN 1 ELSE 0 END AS scale, a.quantity
  FROM amatrix a JOIN ranges r ON a.item_id = r.item_id),
x AS (SELECT customer_id, item_id, (quantity - data_min) / scale AS value, scale, data_min
      FROM scaled),
emb AS (
  SELECT customer_id, {", ".join(f"sum(value * ({d.format('item_id')})) AS e{j}"
                                 for j, d in enumerate(_DIRECTIONS))}
  FROM x GROUP BY customer_id)"""


def _given_directions(spark: SparkSession, sf_dir: str):
    """Scaled cells keyed by the ids themselves, the given item vectors, the
    item ranges and the matrices."""
    from basketry.session import materialize
    p, i, c, m, am = _matrix(spark, sf_dir)
    am = materialize(am)
    ranges = materialize(inter.item_ranges(am, i))
    cells = inter.minmax_scale(am, ranges).select(
        F.col("customer_id").alias("user_idx"), F.col("item_id").alias("item_idx"), "value")
    vectors = i.select(F.col("item_id").alias("item_idx"), F.array(*[
        F.expr(d.format("item_id")).cast("double") for d in _DIRECTIONS]).alias("features"))
    return cells, vectors, ranges, am, m, i, c


@register("user_embeddings", with_(_MATRIX_SQL, _GIVEN_V_SQL) + "\nSELECT customer_id, " + ", ".join(
    f"round(e{j}, 6) + 0.0 AS e{j}" for j in range(_WIDTH)) + " FROM emb")
def user_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X V of every active customer's scaled vector, V given by the keys."""
    cells, vectors, *_ = _given_directions(spark, sf_dir)
    e = recon.encode(cells, vectors, _WIDTH)
    return e.select(F.col("user_idx").alias("customer_id"), *[
        (F.round(F.get("features", F.lit(j)), 6) + 0.0).alias(f"e{j}") for j in range(_WIDTH)])


_FITTED_SQL = " + ".join(f"e.e{j} * ({d.format('x.item_id')})" for j, d in enumerate(_DIRECTIONS))


@register("reconstructed_cells", with_(_MATRIX_SQL, _GIVEN_V_SQL) + f"""
SELECT x.customer_id, x.item_id, round({_FITTED_SQL}, 6) + 0.0 AS fitted,
       round(({_FITTED_SQL}) * x.scale + x.data_min, 6) + 0.0 AS quantity
FROM x JOIN emb e ON x.customer_id = e.customer_id""")
def reconstructed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 + R6: x V V^T at the matrix' own cells, scaled and in quantities."""
    cells, vectors, ranges, *_ = _given_directions(spark, sf_dir)
    fitted = recon.reconstruct(cells, recon.encode(cells, vectors, _WIDTH), vectors).select(
        F.col("user_idx").alias("customer_id"), F.col("item_idx").alias("item_id"), "fitted",
        F.col("fitted").alias("quantity"))
    out = rounded(inter.inverse_scale(fitted, ranges, "quantity"))
    # zero has one sign
    return out.select("customer_id", "item_id", *[(F.col(c) + 0.0).alias(c)
                                                  for c in ("fitted", "quantity")])


# Embeddings in whole 1024ths, so that scores are whole numbers on both sides.
_WHOLE = "CAST(floor({0} * 1024 + 0.3141) AS BIGINT)"


@register("recommend_reconstructed_given", with_(_MATRIX_SQL, _GIVEN_V_SQL) + f""",
u AS (SELECT customer_id, {", ".join(_WHOLE.format(f"e{j}") + f" AS e{j}" for j in range(_WIDTH))}
      FROM emb),
v AS (SELECT DISTINCT item_id, scale, data_min FROM x),
scored AS (
  SELECT e.customer_id, x.item_id, ({_FITTED_SQL}) * x.scale + x.data_min AS score,
         CAST(row_number() OVER (PARTITION BY e.customer_id ORDER BY
              ({_FITTED_SQL}) * x.scale + x.data_min DESC, x.item_id) AS INTEGER) AS rank
  FROM u e CROSS JOIN v x
  WHERE NOT EXISTS (SELECT 1 FROM matrix m WHERE m.customer_id = e.customer_id
                    AND m.item_id = x.item_id AND m.quantity > 0)
  QUALIFY rank <= {K})
SELECT customer_id, item_id, rank, CAST(score AS DOUBLE) AS score FROM scored""")
def recommend_reconstructed_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R11 + R12 + R6 + W3: embeddings times item vectors, scaled back to
    quantities, history masked, the best K; V given by the keys."""
    cells, vectors, ranges, am, m, i, c = _given_directions(spark, sf_dir)
    e = recon.encode(cells, vectors, _WIDTH).select("user_idx", F.transform(
        "features", lambda x: F.floor(x * 1024 + 0.3141).cast("double")).alias("features"))
    columns = am.select("item_id", F.col("item_id").alias("item_idx")).distinct()
    users, items = recon.score_vectors(e, vectors, ranges, columns)
    seen = inter.positive(m).select(F.col("customer_id").alias("user_idx"),
                                    F.col("item_id").alias("item_idx"))
    return rec.score_topk(users, items, seen, K).select(
        F.col("user_idx").alias("customer_id"), F.col("item_idx").alias("item_id"), "rank", "score")


_STEPS = 3


def _power_sql() -> str:
    """The leading direction after ``_STEPS`` products, each made of length 1."""
    out = """
q0 AS (SELECT item_id, value / sqrt(sum(value * value) OVER ()) AS value FROM (
  SELECT DISTINCT item_id, CAST(1 + item_id % 7 AS DOUBLE) AS value FROM x))"""
    for s in range(1, _STEPS + 1):
        out += f""",
y{s} AS (SELECT x.customer_id, sum(x.value * q.value) AS value
  FROM x JOIN q{s - 1} q ON x.item_id = q.item_id GROUP BY x.customer_id),
z{s} AS (SELECT x.item_id, sum(x.value * y.value) AS value
  FROM x JOIN y{s} y ON x.customer_id = y.customer_id GROUP BY x.item_id),
q{s} AS (SELECT item_id, value / sqrt(sum(value * value) OVER ()) AS value FROM z{s})"""
    return out + f""",
last AS (SELECT x.customer_id, sum(x.value * q.value) AS value
  FROM x JOIN q{_STEPS} q ON x.item_id = q.item_id GROUP BY x.customer_id)
SELECT q.item_id, round(q.value, 6) AS direction,
       round((SELECT sqrt(sum(value * value)) FROM last), 6) AS singular FROM q{_STEPS} q"""


@register("leading_direction", with_(_MATRIX_SQL, _GIVEN_V_SQL) + "," + _power_sql())
def leading_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit for one direction, a set number of products from a given
    start; its singular value is the length of X V."""
    cells, vectors, *_ = _given_directions(spark, sf_dir)
    # the fit keeps the start of the items that have cells
    start = vectors.select("item_idx").distinct().select("item_idx", F.array(
        (F.lit(1) + F.col("item_idx") % 7).cast("double")).alias("features"))
    model = recon.fit(cells, rank=1, extra=0, iterations=_STEPS, tolerance=0.0, start=start)
    return rounded(model.vectors.select(
        F.col("item_idx").alias("item_id"), F.get("features", F.lit(0)).alias("direction"),
        F.lit(model.singular[0]).alias("singular")))


@register("recommend_reconstructed")
def recommend_reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear reconstruction fitted on the training customers, scores in
    quantities, history masked; popularity fallback."""
    from basketry.plans import training
    p, i, c = tables(spark, sf_dir)
    t = training.train(p, i, c, backend="linear")
    return rounded(training.recommend(t, c.select("customer_id"), i, K))


@register("evaluation_reconstructed")
def evaluation_reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17 with linear reconstruction."""
    from basketry.plans import training
    p, i, c = tables(spark, sf_dir)
    t = training.train(p, i, c, backend="linear")
    return rounded(rec.summarize(training.evaluate(t, p, K)))


# ---------------------------------------------------------------- cleaning / enrichment
from basketry.functions import catalog  # noqa: E402


@register("merged_purchases", with_() + """
SELECT p.customer_id, p.item_id, p.quantity, p.purchase_date,
       CAST(p.total_price AS DOUBLE) AS total_price,
       coalesce(p.employee_id, 'Unknown') AS employee_id,
       i.item_name, i.item_category, i.item_subcategory, CAST(i.unit_price AS DOUBLE) AS unit_price,
       c.age, c.gender, c.segment
FROM purchases p LEFT JOIN items i ON p.item_id = i.item_id
LEFT JOIN customers c ON p.customer_id = c.customer_id""")
def merged_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + J1 + J2 + P1 + P2: the enriched fact table."""
    p, i, c = tables(spark, sf_dir)
    m = sales.merged(sales.fill_employee(p), i, c.select("customer_id", "age", "gender", "segment"))
    return m.select("customer_id", "item_id", "quantity", "purchase_date",
                    F.col("total_price").cast("double").alias("total_price"), "employee_id",
                    "item_name", "item_category", "item_subcategory",
                    F.col("unit_price").cast("double").alias("unit_price"),
                    "age", "gender", "segment")


@register("preprocessed_customers", with_() + """
SELECT customer_id, zip_code, segment,
       round(coalesce(CAST(age AS DOUBLE), (SELECT avg(age) FROM customers)), 6) AS age,
       registration_date,
       CAST(email_subscription AS INTEGER) AS email_subscription,
       CAST(sms_subscription AS INTEGER) AS sms_subscription,
       CAST(coalesce(gender, 'Unknown') = 'F' AS INTEGER) AS gender_f,
       CAST(coalesce(gender, 'Unknown') = 'M' AS INTEGER) AS gender_m,
       CAST(coalesce(gender, 'Unknown') = 'Unknown' AS INTEGER) AS gender_unknown
FROM customers""")
def preprocessed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 = P3 + P4 + P5 + P6 + P7."""
    return rounded(inter.preprocess_customers(wh.customers(spark, sf_dir)))


@register("item_rule_subcategories", "SELECT p_partkey AS item_id, p_name AS item_name, CASE " +
          " ".join(f"WHEN {' OR '.join(f'contains(p_name, {chr(39)}{n}{chr(39)})' for n in needles)} "
                   f"THEN '{label}'" for label, needles in catalog.PART_RULES) +
          " ELSE 'Other' END AS item_subcategory FROM part")
def item_rule_subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 (+F1): ordered substring rules, first match wins, over part names."""
    i = wh.items(spark, sf_dir)
    return i.select("item_id", "item_name",
                    catalog.classify("item_name", catalog.PART_RULES).alias("item_subcategory"))


@register("known_users", with_(_MATRIX_SQL) + """
SELECT customer_id FROM active
UNION ALL
SELECT DISTINCT customer_id FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM active)""")
def known_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users plus every other catalogue customer with zero interactions."""
    p, _, c = tables(spark, sf_dir)
    m = inter.user_item_matrix(p)
    return inter.register_customers(inter.active_users(m, MIN_ITEMS), c)


@register("preprocessed_items", with_() + """
SELECT item_id, coalesce(item_name, 'Unknown') AS item_name,
       coalesce(item_category, 'Unknown') AS item_category,
       coalesce(item_subcategory, 'Unknown') AS item_subcategory,
       CAST(unit_price AS DOUBLE) AS unit_price
FROM items""")
def preprocessed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + P8: NULL strings become 'Unknown' (prices stay numeric, V10)."""
    i = inter.preprocess_items(wh.items(spark, sf_dir))
    return i.withColumn("unit_price", F.col("unit_price").cast("double"))


@register("preprocessed_items_gaps", with_() + """
SELECT item_id, coalesce(CASE WHEN item_category = 'Service' THEN item_name END, 'Unknown')
         AS item_name, item_category, coalesce(nullif(item_subcategory, (SELECT min(item_subcategory)
         FROM items)), 'Unknown') AS item_subcategory, CAST(unit_price AS DOUBLE) AS unit_price
FROM items""")
def preprocessed_items_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 + P8 where text is missing: products without a name, one subcategory blank."""
    from basketry.functions.columns import scalar
    i = wh.items(spark, sf_dir)
    blank = scalar(i.agg(F.min("item_subcategory")))
    i = i.withColumn("item_name", F.when(F.col("item_category") == "Service", F.col("item_name")))
    i = inter.preprocess_items(i.withColumn("item_subcategory",
                                            F.nullif(F.col("item_subcategory"), blank)))
    return i.withColumn("unit_price", F.col("unit_price").cast("double"))


@register("rescaled_interactions", with_(_MATRIX_SQL) + """
SELECT customer_id, item_id, CAST(quantity AS DOUBLE) AS quantity FROM amatrix
WHERE item_id IN (SELECT item_id FROM items)""")
def rescaled_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 + R6: scaled with the fitted ranges and back."""
    _, i, _, _, am = _matrix(spark, sf_dir)
    ranges = inter.item_ranges(am, i)
    back = inter.inverse_scale(inter.minmax_scale(am, ranges), ranges, "value")
    return rounded(back.select("customer_id", "item_id", F.col("value").alias("quantity")))


@register("event_item_matrix", """
SELECT user_id AS customer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
       CAST(count(*) AS BIGINT) AS quantity
FROM events
WHERE event_type = 'purchase' AND user_id IS NOT NULL
  AND json_extract_string(props, '$.k') IS NOT NULL
GROUP BY 1, 2""")
def event_item_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 over the second purchase source (purchase events, item key from props)."""
    return inter.user_item_matrix(wh.event_purchases(spark, sf_dir))


# ---------------------------------------------------------------- laid-out and growing tables
@register("purchases_with_segments", with_() + """
SELECT p.customer_id, p.item_id, p.purchase_date, CAST(p.total_price AS DOUBLE) AS total_price,
       c.segment
FROM purchases p LEFT JOIN customers c ON p.customer_id = c.customer_id""")
def purchases_with_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + J2: the join by customer between tables in the same buckets."""
    from basketry.sources import layout
    p, _, c = tables(spark, sf_dir)
    joined = layout.join_customers(layout.bucket_purchases(p), layout.bucket_customers(
        c.select("customer_id", "segment")))
    return joined.select("customer_id", "item_id", "purchase_date",
                         F.col("total_price").cast("double").alias("total_price"), "segment")


def _folded(spark: SparkSession, sf_dir: str) -> str:
    """A state folder that the purchases went into in batches by year, one of
    them twice, with a compaction in between."""
    import uuid

    from basketry.session import checkpoint_dir, materialize
    from basketry.streaming import state
    base = f"{checkpoint_dir(spark).rstrip('/')}/basketry-state-{uuid.uuid4().hex}"
    p, _, _ = tables(spark, sf_dir)
    # four folds of two parts each read the purchases: lines meet their orders once
    p = materialize(p.select("customer_id", "item_id", "quantity", "purchase_date"))
    year = F.pmod(F.year("purchase_date"), F.lit(3))
    batches = [p.where(year == 0), p.where(year == 1),
               p.where((year == 2) | F.col("purchase_date").isNull())]
    state.fold(batches[0], base, 0)
    state.fold(batches[1], base, 1)
    state.compact(spark, base)
    state.fold(batches[2], base, 2)
    state.fold(batches[1], base, 1)                 # replayed after the compaction
    state.fold(batches[2], base, 2)                 # replayed
    return base


@register("folded_matrix", with_(_MATRIX_SQL) + "\nSELECT * FROM matrix")
def folded_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 from a state that grew by batches."""
    from basketry.streaming import state
    return state.read(spark, _folded(spark, sf_dir))


@register("folded_streaks", with_(_STREAK_SQL) + """
SELECT customer_id, longest_purchase_streak FROM streak""")
def folded_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 from the purchase days of a state that grew by batches."""
    from basketry.streaming import state
    return state.streaks(spark, _folded(spark, sf_dir))
