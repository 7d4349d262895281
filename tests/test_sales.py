import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import sales
from basketry.plans import sales_report
from tests import fixtures as fx


def test_merged_keeps_every_purchase(spark):
    m = sales.merged(fx.purchases(spark), fx.items(spark), fx.customers(spark))
    assert m.count() == 10
    assert m.where(F.col("item_name").isNull()).count() == 1


def test_fill_employee(spark):
    p = sales.fill_employee(fx.purchases(spark))
    assert p.where(F.col("employee_id") == "Unknown").count() == 6


def test_counts_drop_unknown_items_and_break_ties_by_name(spark):
    top = sales.top_by_count(fx.purchases(spark), fx.items(spark), "item_name", 10).collect()
    names = [(r.item_name, r.n_purchases, r.rank) for r in top]
    # I1 and I3 both have 3 rows; the name breaks the tie
    assert names[:2] == [("Haircut (Men's)", 3, 1), ("Shampoo (Dry)", 3, 2)]
    assert all(n is not None for n, _, _ in names)
    assert sum(n for _, n, _ in names) == 9


def test_bottom_is_tail_of_descending_list(spark):
    p, i = fx.purchases(spark), fx.items(spark)
    full = [r.item_name for r in sales.top_by_count(p, i, "item_name", 10).collect()]
    bottom = [r.item_name for r in sales.bottom_by_count(p, i, "item_name", 2).collect()]
    assert bottom == list(reversed(full[-2:]))


def test_revenue_lists(spark):
    p, i = fx.purchases(spark), fx.items(spark)
    top = {r.item_name: r.revenue for r in sales.top_by_revenue(p, i, "item_name", 10).collect()}
    assert top["Haircut (Men's)"] == pytest.approx(90.0)
    low = [r.item_name for r in sales.bottom_by_revenue(p, i, "item_name", 2).collect()]
    assert low == ["Lipstick", "Hair Mask"]


def test_share_sums_to_100(spark):
    s = sales.share(fx.purchases(spark), fx.items(spark), "item_category", "revenue")
    assert s.agg(F.sum("share_pct")).first()[0] == pytest.approx(100.0)


def test_distribution_matches_pandas(spark):
    p = fx.purchases(spark)
    pdf = p.toPandas()
    pdf["total_price"] = pdf["total_price"].astype(float)
    per = pdf.groupby("customer_id")["total_price"].mean()
    row = sales.spend_distribution(p).first()
    assert row["count"] == per.count()
    assert row["mean"] == pytest.approx(per.mean())
    assert row["std"] == pytest.approx(per.std())
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert row[name] == pytest.approx(per.quantile(q))


def test_exact_quantiles(spark):
    from basketry.operators import stats
    assert stats.quantiles(spark.range(0).select(F.col("id").alias("x")), "x", [0.5]) == [None]
    one = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert stats.quantiles(one, "x", [0.0, 0.5, 1.0]) == [2.0, 2.0, 2.0]
    df = spark.range(0, 5000).select((F.col("id") * 7 % 1013).cast("double").alias("x"))
    s = pd.Series([r.x for r in df.collect()])
    got = stats.quantiles(df, "x", [0.1, 0.25, 0.5, 0.9], partitions=5)
    assert got == pytest.approx([s.quantile(q) for q in (0.1, 0.25, 0.5, 0.9)])


def test_segment_means(spark):
    seg = {r.segment: r.mean_spend
           for r in sales.spend_by_segment(fx.purchases(spark), fx.customers(spark)).collect()}
    assert seg["New"] == pytest.approx(36.0)
    assert None not in seg


def test_report_guard_when_names_missing(spark):
    items = fx.items(spark).withColumn("item_name", F.lit(None).cast("string"))
    rep = sales_report.sales_report(fx.purchases(spark), items, fx.customers(spark))
    msgs = {r.section: r.message for r in rep.where(F.col("message").isNotNull()).collect()}
    assert msgs["top_selling_items"] == "Cannot be determined (missing ItemName data)"
    assert "top_selling_categories" not in msgs


def test_report_without_segment_column(spark):
    rep = sales_report.sales_report(fx.purchases(spark), fx.items(spark),
                                    fx.customers(spark).drop("segment"))
    row = rep.where(F.col("section") == "customer_spending_by_segment").first()
    assert row.message.startswith("Cannot be determined")


def test_exact_quantiles_with_a_hot_value(spark):
    from basketry.operators import stats
    # a third of all values identical: one (value, count) pair
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(50.0)).otherwise((F.col("id") * 13 % 997).cast("double"))
        .alias("x"))
    s = pd.Series([r.x for r in df.collect()])
    qs = [0.05, 0.25, 0.5, 0.75, 0.99]
    got = stats.quantiles(df, "x", qs, partitions=5)
    assert got == pytest.approx([s.quantile(q) for q in qs])


PRICED = ["revenue_top_items", "revenue_bottom_items", "revenue_top_categories",
          "revenue_top_subcategories", "customer_spending", "customer_spending_by_segment"]


@pytest.mark.parametrize("drop", [False, True])
def test_report_without_prices(spark, drop):
    p = fx.purchases(spark)
    p = p.drop("total_price") if drop else p.withColumn(
        "total_price", F.lit(None).cast("decimal(18,2)"))
    rep = sales_report.sales_report(p, fx.items(spark), fx.customers(spark)).collect()
    assert sorted(r.section for r in rep if r.message) == sorted(PRICED)
    assert not any(r.section in PRICED and r.message is None for r in rep)
    assert any(r.section == "top_selling_items" and r.value for r in rep)


@pytest.mark.parametrize("column,sections", [
    ("item_name", ["top_selling_items", "bottom_selling_items", "revenue_top_items",
                   "revenue_bottom_items"]),
    ("item_category", ["top_selling_categories", "revenue_top_categories"]),
    ("item_subcategory", ["top_selling_subcategories", "bottom_selling_subcategories",
                          "revenue_top_subcategories"])])
def test_report_without_an_item_column(spark, column, sections):
    rep = sales_report.sales_report(fx.purchases(spark), fx.items(spark).drop(column),
                                    fx.customers(spark)).collect()
    assert sorted(r.section for r in rep if r.message) == sorted(sections)


def test_report_without_customer_ids(spark):
    for p in (fx.purchases(spark).drop("customer_id"),
              fx.purchases(spark).withColumn("customer_id", F.lit(None).cast("string"))):
        rep = sales_report.sales_report(p, fx.items(spark), fx.customers(spark)).collect()
        assert sorted(r.section for r in rep if r.message) == [
            "customer_spending", "customer_spending_by_segment"]


def test_merged_joins_the_wide_items_last(spark):
    p, i, c = fx.purchases(spark), fx.items(spark), fx.customers(spark)
    plan = sales.merged(p, i, c)._jdf.queryExecution().analyzed().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "item_id" in joins[0] and "customer_id" in joins[1]      # the outer one first
