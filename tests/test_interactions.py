import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import interactions as I
from tests import fixtures as fx


def test_matrix_and_active_users(spark):
    m = I.user_item_matrix(fx.purchases(spark))
    got = {(r.customer_id, r.item_id): r.quantity for r in m.collect()}
    assert got[("C1", "I1")] == 3 and got[("C2", "I3")] == 3
    assert {r.customer_id for r in I.active_users(m, 3).collect()} == {"C1", "C3"}
    assert {r.customer_id for r in I.active_users(m, 0).collect()} == {"C1", "C2", "C3"}


def test_ranges_with_implicit_zeros(spark):
    rows = [("u1", "a", 2), ("u2", "a", 4), ("u1", "b", 3)]
    m = spark.createDataFrame(rows, "customer_id string, item_id string, quantity bigint")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    r = {x.item_id: x for x in I.item_ranges(m, items).collect()}
    assert (r["a"].data_min, r["a"].data_max, r["a"].scale) == (2.0, 4.0, 2.0)   # everyone bought a
    assert (r["b"].data_min, r["b"].data_max) == (0.0, 3.0)
    assert (r["c"].data_min, r["c"].data_max, r["c"].scale) == (0.0, 0.0, 1.0)   # never bought
    s = {(x.customer_id, x.item_id): x.value for x in I.minmax_scale(m, I.item_ranges(m, items)).collect()}
    assert s[("u1", "a")] == 0.0 and s[("u2", "a")] == 1.0 and s[("u1", "b")] == 1.0


def test_cutoff_clamps_to_month_end(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 31),), (dt.date(2024, 1, 2),)], "purchase_date date")
    row = I.test_cutoff(df, 3).first()
    assert row.cutoff_date == dt.date(2024, 2, 29)


def test_split_sets_overlap(spark):
    s = {r.customer_id: (r.in_train, r.in_test) for r in I.temporal_split(fx.purchases(spark), 3).collect()}
    # latest date 21 Jan 2023 -> cut 21 Oct 2022: everybody is in the test set
    assert s["C3"] == (False, True)
    p = fx.purchases(spark).unionByName(spark.createDataFrame(
        [("C1", "I1", 1, dt.date(2023, 6, 1), fx.money(30), None)], fx.PURCHASE_SCHEMA))
    s = {r.customer_id: (r.in_train, r.in_test) for r in I.temporal_split(p, 3).collect()}
    assert s["C1"] == (True, True) and s["C2"] == (True, False)


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", "e"]], "id string")
    got = {r.id: r.idx for r in I.dense_index(df, "id", "idx", partitions=3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "e": 3}


def test_preprocess_customers(spark):
    c = {r.customer_id: r for r in I.preprocess_customers(fx.customers(spark)).collect()}
    assert c["C2"].age == pytest.approx((30 + 50 + 41) / 3)
    assert (c["C3"].gender_unknown, c["C3"].gender_f) == (1, 0)
    assert c["C1"].email_subscription == 1 and c["C1"].sms_subscription == 0


def test_register_customers(spark):
    known = spark.createDataFrame([("C1",), ("C2",)], "customer_id string")
    new = spark.createDataFrame([("C2",), ("C9",)], "customer_id string")
    assert sorted(r.customer_id for r in I.register_customers(known, new).collect()) == ["C1", "C2", "C9"]


def test_inverse_scale(spark):
    ranges = spark.createDataFrame([("a", 2.0, 4.0, 2.0), ("c", 0.0, 0.0, 1.0)],
                                   "item_id string, data_min double, data_max double, scale double")
    scores = spark.createDataFrame([("u", "a", 0.5), ("u", "c", 0.25)],
                                   "customer_id string, item_id string, score double")
    got = {r.item_id: r.score for r in I.inverse_scale(scores, ranges).collect()}
    assert got == {"a": 3.0, "c": 0.25}


def test_scaling_needs_fitted_ranges(spark):
    import pytest
    cells = spark.createDataFrame([("u", "a", 3), ("u", "z", 1)],
                                  "customer_id string, item_id string, quantity bigint")
    with pytest.raises(ValueError):
        I.minmax_scale(cells, None)
    ranges = spark.createDataFrame([("a", 1.0, 5.0, 4.0)],
                                   "item_id string, data_min double, data_max double, scale double")
    assert [tuple(r) for r in I.minmax_scale(cells, ranges).collect()] == [("u", "a", 0.5)]


def test_ranges_without_active_users(spark):
    none = spark.createDataFrame([], "customer_id string, item_id string, quantity bigint")
    items = spark.createDataFrame([("a",)], "item_id string")
    assert tuple(I.item_ranges(none, items).first()) == ("a", 0.0, 0.0, 1.0)


def test_positions_join_their_offsets(spark):
    ids = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("k"))
    out = I.dense_index(ids, "k", "at", partitions=6)
    assert all(r.k == r.at for r in out.collect())
    assert "map(" not in out._jdf.queryExecution().analyzed().toString()
