import pytest
from pyspark.sql import functions as F

from basketry.operators import features as feat
from tests import fixtures as fx


def _by_id(df):
    return {r.customer_id: r for r in df.collect()}


def test_streaks(spark):
    s = _by_id(feat.longest_streaks(fx.purchases(spark), "2023-01-01"))
    assert s["C1"].longest_purchase_streak == 3
    assert s["C2"].longest_purchase_streak == 1
    assert s["C3"].longest_purchase_streak == 2   # 20 and 21 January


def test_gaps_closed_form_equals_windowed(spark):
    p = fx.purchases(spark)
    agg = _by_id(feat.customer_aggregates(p, fx.items(spark), "2023-12-31"))
    gaps = feat.daily_gaps(p).toPandas()
    c1 = gaps[gaps.customer_id == "C1"]
    per_row = c1.gap_days.fillna(0).sum() / (c1.n_rows.sum() - 1)
    assert agg["C1"].avg_time_between_purchases == pytest.approx(per_row) == pytest.approx(1.0)
    assert agg["C2"].avg_time_between_purchases is None


def test_features_null_rules(spark):
    f = _by_id(feat.customer_features(fx.purchases(spark), fx.items(spark),
                                      fx.customers(spark)))
    assert set(f) == {"C1", "C2", "C3"}
    # single purchase: the largest mean gap of all customers
    assert f["C2"].avg_time_between_purchases == pytest.approx(
        max(f["C1"].avg_time_between_purchases, f["C3"].avg_time_between_purchases))
    assert f["C2"].age == 0.0                    # missing age -> 0 in segmentation
    assert (f["C3"].gender_f, f["C3"].gender_m) == (0, 0)
    assert f["C3"].service_ratio == 0.0          # products only
    assert f["C3"].product_ratio == pytest.approx(1.0)   # unknown item has no category
    assert f["C1"].frequency == 6 and f["C1"].monetary_value == pytest.approx(219.0)
    assert f["C1"].aov == pytest.approx(219.0 / 6)
    assert f["C1"].recency == 359


def test_standardize_population_std_and_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "customer_id string, x double, c double")
    s = _by_id(feat.standardize(df, ["x", "c"]))
    assert s["a"].x == pytest.approx(-1.0) and s["b"].x == pytest.approx(1.0)
    assert s["a"].c == 0.0


def test_demographics_one_hot(spark):
    d = _by_id(feat.demographics(fx.customers(spark)))
    assert (d["C1"].gender_f, d["C1"].gender_m) == (1, 0)
    assert (d["C3"].gender_f, d["C3"].gender_m) == (0, 0)


def test_gender_values_are_bounded(spark):
    import pytest
    from basketry.operators import features as feat
    few = spark.createDataFrame([("F",), ("M",), (None,), ("F",)], "gender string")
    assert feat.gender_values(few) == ["F", "M"]
    many = spark.range(200).selectExpr("concat('g', id) as gender")
    with pytest.raises(ValueError):
        feat.gender_values(many)
