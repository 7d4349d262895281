"""Purchases in buckets, the state that grows by batches, published models."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from basketry.functions import bits as B
from basketry.operators import features as feat
from basketry.operators import interactions as I
from basketry.operators import itemsets
from basketry.operators import recommend as R
from basketry.plans import training
from basketry.settings import Settings
from basketry.sources import files, layout
from basketry.sources import warehouse as wh
from basketry.streaming import state
from tests import fixtures as fx

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- buckets
def test_bucketed_join_leaves_the_purchases_in_place(spark, tmp_dir):
    p, c = fx.purchases(spark), fx.customers(spark)
    # one customer with most rows, and rows without a customer
    hot = spark.range(3000).select(
        F.lit("C1").alias("customer_id"), F.concat(F.lit("I"), F.col("id") % 7).alias("item_id"),
        F.lit(1).alias("quantity"), F.expr("date_add(date'2023-01-01', cast(id % 90 as int))")
        .alias("purchase_date"), F.lit(5).cast("decimal(18,2)").alias("total_price"),
        F.lit(None).cast("string").alias("employee_id"))
    p = p.unionByName(hot).unionByName(p.limit(2).withColumn("customer_id", F.lit(None)
                                                             .cast("string")))
    facts = layout.bucket_purchases(p, "t_facts", 8, 4, os.path.join(tmp_dir, "facts"))
    dim = layout.bucket_customers(c.select("customer_id", "segment"), "t_dim", 8, 4,
                                  os.path.join(tmp_dir, "dim"))
    # the hot customer lies in several buckets
    assert facts.where("customer_id = 'C1'").select("salt").distinct().count() == 4
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = layout.join_customers(facts, dim)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert _rows(out.select(*p.columns, "segment")) == _rows(
            p.join(c.select("customer_id", "segment"), "customer_id", "left")
            .select(*p.columns, "segment"))
        spent = layout.by_customer(facts, F.sum("total_price").alias("s"))
        assert "Exchange" not in spent._jdf.queryExecution().executedPlan().toString()
        assert _rows(spent.groupBy("customer_id").agg(F.sum("s").cast("decimal(18,2)"))) == _rows(
            p.groupBy("customer_id").agg(F.sum("total_price").cast("decimal(18,2)")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        layout.drop(spark, "t_facts", "t_dim")


# ---------------------------------------------------------------- item sets
def test_item_sets_count_and_meet(spark):
    p = fx.purchases(spark)
    m = I.user_item_matrix(p).unionByName(spark.createDataFrame(
        [("C8", "I1", 0), ("C9", "I2", -1)], "customer_id string, item_id string, quantity bigint"))
    index = I.dense_index(m, "item_id", "item_idx")
    assert _rows(itemsets.items_per_user(m, index)) == _rows(I.items_per_user(m))
    with pytest.raises(ValueError):
        itemsets.items_per_user(m)
    recs = m.where("item_id in ('I1', 'I3', 'IX')").select("customer_id", "item_id")
    recs = recs.unionByName(recs)                               # repeats count once
    actual = p.where("item_id <> 'I2'").select("customer_id", "item_id").distinct()
    assert _rows(itemsets.precision_recall(recs, actual, 3, index)) == _rows(
        R.precision_recall(recs, actual, 3))


# ---------------------------------------------------------------- the state
def test_state_equals_one_run(spark, tmp_dir):
    p = fx.purchases(spark)
    base = os.path.join(tmp_dir, "state")
    with pytest.raises(FileNotFoundError):
        state.read(spark, base)
    days = [p.where(F.dayofmonth("purchase_date") % 3 == k) for k in range(3)]
    assert state.compact(spark, base) == -1
    for k, batch in enumerate(days):
        assert state.fold(batch, base, k)
        if k == 1:
            assert state.compact(spark, base) == 1
    whole = lambda: (_rows(state.read(spark, base)), _rows(state.read(spark, base, "days")),
                     _rows(state.streaks(spark, base)))
    want = (_rows(I.user_item_matrix(p)), _rows(feat.day_words(p)), _rows(feat.longest_streaks(p)))
    assert whole() == want
    assert not state.fold(days[0], base, 0)                     # part of the whole already
    assert state.fold(days[2], base, 2) and whole() == want     # replaced by itself
    # a batch that was not written to its end, and a compaction that was not, do not count
    os.makedirs(os.path.join(base, "changes", "batch=3", "matrix"))
    os.makedirs(os.path.join(base, "whole", "upto=9", "matrix"))
    assert state.compacted(spark, base) == 1 and whole() == want
    assert state.compact(spark, base) == 2 and whole() == want
    assert state.compact(spark, base) == -1
    # what derives from the matrix is that of one run
    m = state.read(spark, base)
    am = m.join(I.active_users(m, 2), "customer_id", "left_semi")
    full = I.interactions(p, 2)
    assert _rows(I.popularity(am, m)) == _rows(I.popularity(full, I.user_item_matrix(p)))
    assert _rows(I.item_ranges(am, fx.items(spark))) == _rows(I.item_ranges(full, fx.items(spark)))


def test_state_follows_a_stream(spark, tmp_dir):
    p = fx.purchases(spark)
    src, base, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "state", "ckpt"))
    for k in range(3):
        p.where(F.hash("item_id", "purchase_date") % 3 == k - 1).coalesce(1).write.mode(
            "append").parquet(src)
    p.where(~(F.hash("item_id", "purchase_date") % 3).isin(-1, 0, 1)).coalesce(1).write.mode(
        "append").parquet(src)
    for _ in range(2):                                          # a restart finds nothing new
        state.follow(spark, src, base, ckpt, p.schema, compact_every=2,
                     available_now=True).awaitTermination(120)
        assert _rows(state.read(spark, base)) == _rows(I.user_item_matrix(p))
        assert _rows(state.streaks(spark, base)) == _rows(feat.longest_streaks(p))
    # days united twice are the same days
    twice = state.read(spark, base, "days")
    assert _rows(B.merge(twice.unionByName(twice), ["customer_id"])) == _rows(twice)


# ---------------------------------------------------------------- published models
def test_publish_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a", "name.json")
    os.makedirs(os.path.dirname(path))
    done = []
    writers = [threading.Thread(target=lambda i=i: done.append(
        files.publish_text(spark, path, f"text {i}" * 1000))) for i in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == [False] * 5 + [True]
    text = files.read_text(spark, path)
    assert text in {f"text {i}" * 1000 for i in range(6)}
    assert files.names(spark, os.path.dirname(path))[-1] == "name.json"
    assert files.names(spark, tmp_dir + "/none") == [] == files.folders(spark, tmp_dir + "/none")


@needs_data
def test_published_versions(spark, tmp_dir):
    """Two writers of one version, and a reader while another version is written."""
    p, i, c = wh.purchases(spark, SF), wh.items(spark, SF), wh.customers(spark, SF)
    t = training.train(p, i, c, Settings(embedding_dim=3), max_iter=2, backend="linear")
    base = os.path.join(tmp_dir, "models")
    with pytest.raises(FileNotFoundError):
        training.load_latest(spark, base)
    results = []

    def write():
        try:
            results.append(training.save(t, base, "20240101_000000"))
        except FileExistsError as e:
            results.append(e)

    both = [threading.Thread(target=write) for _ in range(2)]
    for w in both:
        w.start()
    for w in both:
        w.join()
    assert sorted(type(r).__name__ for r in results) == ["FileExistsError", "str"]
    reader = training.load_latest(spark, base)
    before = _rows(reader.ranges)
    t.ranges = t.ranges.withColumn("scale", F.col("scale") + 1)
    training.save(t, base, "20250101_000000")
    assert training.versions(spark, base) == ["20240101_000000", "20250101_000000"]
    assert _rows(reader.ranges) == before
    assert _rows(training.load(spark, base, "20240101_000000").ranges) == before
    assert _rows(training.load_latest(spark, base).ranges) != before
    # parts that no manifest names are not there for a reader
    os.makedirs(os.path.join(base, ".parts-dead", "model"))
    assert training.load_latest(spark, base).version == "20250101_000000"


def test_folds_do_not_join_the_purchases_again(spark, monkeypatch):
    import datetime as dt

    from basketry import registry
    lines = spark.createDataFrame([(1, 10, 2), (2, 11, 1), (3, 10, 1)],
                                  "o bigint, item_id bigint, quantity int")
    orders = spark.createDataFrame(
        [(1, 7, dt.date(2001, 1, 1)), (2, 7, dt.date(2000, 1, 1)), (3, 8, None)],
        "o bigint, customer_id bigint, purchase_date date")
    monkeypatch.setattr(registry, "tables", lambda *a: (lines.join(orders, "o"), None, None))
    plans, fold = [], state.fold
    monkeypatch.setattr(state, "fold", lambda p, *a: plans.append(
        p._jdf.queryExecution().analyzed().toString()) or fold(p, *a))
    got = registry.folded_matrix(spark, "")
    assert sorted(map(tuple, got.collect())) == [(7, 10, 2), (7, 11, 1), (8, 10, 1)]
    assert len(plans) == 5 and not any("Join" in p for p in plans)
