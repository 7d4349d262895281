"""A customer and an item each holding a third of all rows: results must equal
a brute-force pandas computation of the same definitions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import features as feat
from basketry.operators import interactions as I
from basketry.operators import recommend as R
from tests import fixtures as fx

REF = "2023-12-31"


def _data(spark, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    cust = np.where(np.arange(n) % 3 == 0, "HOT", [f"C{x:03d}" for x in rng.integers(0, 120, n)])
    item = np.where(np.arange(n) % 3 == 1, "I00", [f"I{x:02d}" for x in rng.integers(1, 40, n)])
    day = [dt.date(2023, 1, 1) + dt.timedelta(days=int(x)) for x in rng.integers(0, 200, n)]
    qty = rng.integers(1, 4, n)
    price = [fx.money(round(float(x), 2)) for x in rng.uniform(5, 80, n)]
    rows = list(zip(cust.tolist(), item.tolist(), qty.tolist(), day, price, [None] * n))
    p = spark.createDataFrame(rows, fx.PURCHASE_SCHEMA)
    cats = [(f"I{x:02d}", f"name{x % 7}", "Service" if x % 2 else "Product", "S", fx.money(10))
            for x in range(0, 40)]
    i = spark.createDataFrame(cats, fx.ITEM_SCHEMA)
    cs = sorted(set(cust.tolist()))
    c = spark.createDataFrame([(x, 30, "F", dt.date(2022, 1, 1), "1", True, True, "s") for x in cs],
                              fx.CUSTOMER_SCHEMA)
    return p, i, c


def _streak(days):
    days = sorted(set(days))
    best = cur = 1
    for a, b in zip(days, days[1:]):
        cur = cur + 1 if (b - a).days == 1 else 1
        best = max(best, cur)
    return best


def test_features_under_skew(spark):
    p, i, c = _data(spark)
    got = {r.customer_id: r for r in feat.customer_features(p, i, c, ref_date=REF).collect()}
    pdf = p.toPandas().merge(i.toPandas()[["item_id", "item_category"]], on="item_id", how="left")
    pdf["total_price"] = pdf["total_price"].astype(float)
    assert (pdf.customer_id == "HOT").mean() == pytest.approx(1 / 3, abs=0.01)
    for cid, g in pdf.groupby("customer_id"):
        r = got[cid]
        assert r.frequency == len(g)
        assert r.monetary_value == pytest.approx(g.total_price.sum())
        assert r.recency == (dt.date(2023, 12, 31) - g.purchase_date.max()).days
        d = pd.Series(sorted(g.purchase_date)).diff().dropna().map(lambda x: x.days)
        if len(d):
            assert r.avg_time_between_purchases == pytest.approx(d.mean())
        assert r.longest_purchase_streak == _streak(g.purchase_date)
        assert r.service_ratio == pytest.approx((g.item_category == "Service").mean())


def test_popularity_recommendations_under_skew(spark):
    p, i, c = _data(spark)
    m = I.user_item_matrix(p)
    am = m.join(I.active_users(m, 5), "customer_id", "left_semi")
    recs = R.recommend_unseen_by_rank(c.select("customer_id"), m, R.ranked_popularity(am, m), 5)
    got = {}
    for r in recs.orderBy("customer_id", "rank").collect():
        got.setdefault(r.customer_id, []).append(r.item_id)
    mp, amp = m.toPandas(), am.toPandas()
    pop = amp.groupby("item_id").quantity.sum().reindex(mp.item_id.unique(), fill_value=0)
    order = sorted(pop.index, key=lambda x: (-pop[x], x))
    for cid in c.toPandas().customer_id:
        seen = set(mp[(mp.customer_id == cid) & (mp.quantity > 0)].item_id)
        assert got.get(cid, []) == [x for x in order if x not in seen][:5]


def test_fact_row_joins_under_skew(spark):
    """Joins that keep every purchase row: enrichment and cluster labels."""
    from basketry.operators import sales, segments as seg
    p, i, c = _data(spark)
    keys = ["spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")               # shuffle joins, split by AQE
        spark.conf.set(keys[1], "1k")
        spark.conf.set(keys[2], "1k")
        clusters = c.select("customer_id", (F.crc32(F.col("customer_id").cast("binary")) % 3)
                            .cast("int").alias("cluster"))
        got = seg.attach(sales.merged(p, i, c), seg.label_clusters(clusters)).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    pdf = p.toPandas()
    want = pdf.merge(i.toPandas(), on="item_id", how="left").merge(
        clusters.toPandas(), on="customer_id", how="left")
    cols = ["customer_id", "item_id", "purchase_date", "quantity", "item_name", "cluster"]
    assert len(got) == len(pdf)
    assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(
        map(tuple, want[cols].astype(str).values))


def test_training_under_skew(spark):
    """The matrix of the fit holds every (customer, item) of the training customers."""
    from basketry.plans import training
    from basketry.settings import Settings
    p, i, c = _data(spark)
    t = training.train(p, i, c, Settings(embedding_dim=4), max_iter=1)
    pdf = p.toPandas()
    want = pdf.groupby(["customer_id", "item_id"]).quantity.sum()
    got = t.all_matrix.toPandas().set_index(["customer_id", "item_id"]).quantity
    assert got.to_dict() == want.to_dict()
    hot = training.recommend(t, c.where("customer_id = 'HOT'").select("customer_id"), i, 5)
    seen = set(pdf[pdf.customer_id == "HOT"].item_id)
    assert not seen & {r.item_id for r in hot.collect()}
