import os

from pyspark.sql import functions as F

from basketry.sources import generate as G
from basketry.streaming import requests as S
from tests import fixtures as fx


def test_generators(spark):
    c = G.gen_customers(spark, 200, seed=7)
    rows = c.collect()
    assert len(rows) == 200 and rows[0].customer_id == "Cust0001"
    assert all(18 <= r.age <= 75 and r.gender in ("F", "M") for r in rows)
    i = G.gen_items(spark, seed=7)
    cats = {r.item_category for r in i.collect()}
    assert i.count() == 69 and cats == {"Service", "Product"}
    p = G.gen_purchases(spark, c, 2000, seed=7).cache()
    assert 0 < p.count() <= 2000
    j = p.join(c, "customer_id").join(i.select("item_id", "item_category"), "item_id")
    assert j.where(F.col("purchase_date") < F.col("registration_date")).count() == 0
    assert j.where(F.col("purchase_date") > F.lit("2023-12-31").cast("date")).count() == 0
    svc = j.where(F.col("item_category") == "Service")
    assert svc.where((F.col("quantity") != 1) | F.col("employee_id").isNull()).count() == 0
    prod = j.where(F.col("item_category") == "Product")
    assert prod.where((F.col("quantity") > 3) | F.col("employee_id").isNotNull()).count() == 0
    # deterministic in the seed
    assert G.gen_purchases(spark, c, 2000, seed=7).exceptAll(p).count() == 0
    pref = G.gen_purchases(spark, c, 500, seed=7, with_preference=True)
    per = pref.join(i.select("item_id", "item_category"), "item_id").groupBy(
        "customer_id", "item_category").agg(F.countDistinct("preferred_category").alias("n"))
    assert per.agg(F.max("n")).first()[0] == 1     # one preference per customer and kind


def test_request_stream(spark, tmp_dir):
    req_dir = os.path.join(tmp_dir, "req")
    spark.createDataFrame([("C1",), ("C2",)], "customer_id string").write.parquet(req_dir + "/a")
    spark.createDataFrame([("C3",), ("C9",)], "customer_id string").write.parquet(req_dir + "/b")
    answer = S.popularity_answer(fx.purchases(spark), fx.items(spark), k=2, min_items=1)
    q = S.serve(spark, req_dir + "/*", answer, os.path.join(tmp_dir, "out"),
                os.path.join(tmp_dir, "ckpt"), schema="customer_id string", available_now=True)
    q.awaitTermination(120)
    out = {r.customer_id: r for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    assert set(out) == {"C1", "C2", "C3", "C9"}
    assert out["C9"].purchase_history == [] and len(out["C9"].recommendations) == 2
    assert not set(out["C2"].recommendations) & {"Shampoo (Dry)"}
