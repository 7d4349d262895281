import os

import pytest
from pyspark.sql import functions as F

from basketry.plans import sales_report, segmentation
from basketry.settings import Settings
from basketry.sources import files, warehouse as wh

SF = "/root/testdata/sf0.001"


def test_segment_customers_and_export(spark, tmp_dir):
    p, i, c = wh.purchases(spark, SF), wh.items(spark, SF), wh.customers(spark, SF)
    res = segmentation.segment_customers(p, i, c, 3, Settings(n_init=2, fit_max_iter=50),
                                         ref_date=wh.REFERENCE_DATE, epoch=wh.EPOCH)
    a = res.assigned.cache()
    n = res.features.count()
    assert a.count() == n and a.select("customer_id").distinct().count() == n
    assert {r.cluster for r in a.select("cluster").distinct().collect()} <= {0, 1, 2}
    assert a.agg(F.sum("distance")).first()[0] == pytest.approx(res.inertia, rel=1e-6)
    means = segmentation.export_segments(p, res, os.path.join(tmp_dir, "rows"),
                                         os.path.join(tmp_dir, "means"),
                                         os.path.join(tmp_dir, "counts"))
    rows = files.read_table(spark, os.path.join(tmp_dir, "rows"))
    assert rows.count() == p.count()                      # one row per purchase (J5)
    back = files.read_table(spark, os.path.join(tmp_dir, "means"), "csv")
    assert back.count() == means.count() <= 3
    with pytest.raises(ValueError):
        segmentation.segment_customers(p, i, c, None)
    res.release()


def test_write_report(spark, tmp_dir):
    p, i, c = wh.purchases(spark, SF), wh.items(spark, SF), wh.customers(spark, SF)
    rep = sales_report.sales_report(p, i, c)
    out = os.path.join(tmp_dir, "report")
    files.write_report(rep, out)
    back = spark.read.json(out)
    assert back.count() == rep.count()
    assert back.where(F.col("section") == "customer_spending_distribution").count() == 8
