import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from basketry.functions import catalog
from basketry.sources import files
from tests import fixtures as fx

CUSTOMERS_CSV = """CustomerID,Age,Gender,RegistrationDate,ZipCode,EmailSubscription,SMSSubscription
Cust0001,56,F,2021-05-01,02134,True,False
Cust0002,,M,2022-01-03,90210,False,True
"""
ITEMS_CSV = """ItemID,ItemName,ItemCategory,ItemSubcategory,UnitPrice
Item0001,Haircut (Women's),Service,Haircut,42.10
Item0002,Styling Gel,Product,Styling,
"""
PURCHASES_CSV = """CustomerID,ItemID,Quantity,PurchaseDate,TotalPrice,EmployeeID
Cust0001,Item0001,1,2023-03-04 00:00:00,42.10,Emp03
Cust0001,Item0002,2,2023-03-05,30.00,
Cust0001,Item0002,2,2023-03-05,30.00,
"""


def _write(tmp, name, text):
    path = os.path.join(tmp, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_readers(spark, tmp_dir):
    c = files.read_customers(spark, _write(tmp_dir, "c.csv", CUSTOMERS_CSV)).collect()
    assert c[0].zip_code == "02134"            # leading zero kept
    assert c[1].age is None and c[0].registration_date == dt.date(2021, 5, 1)
    i = files.read_items(spark, _write(tmp_dir, "i.csv", ITEMS_CSV)).collect()
    assert str(i[0].unit_price) == "42.10" and i[1].unit_price is None
    p = files.read_purchases(spark, _write(tmp_dir, "p.csv", PURCHASES_CSV))
    assert p.count() == 3                      # identical rows are kept
    assert p.where(F.col("employee_id").isNull()).count() == 2
    assert p.first().purchase_date == dt.date(2023, 3, 4)


def test_columns_are_bound_by_header(spark, tmp_dir):
    """Another order and an extra column read the same; a missing column fails."""
    lines = [r.split(",") for r in ITEMS_CSV.strip().split("\n")]
    order = [4, 0, 3, 1, 2]
    turned = "\n".join(",".join([r[i] for i in order] + ["x"]) for r in lines)
    turned = turned.replace("ItemCategory,x", "ItemCategory,Extra", 1)
    a = files.read_items(spark, _write(tmp_dir, "i.csv", ITEMS_CSV))
    b = files.read_items(spark, _write(tmp_dir, "t.csv", turned + "\n"))
    assert a.columns == b.columns and a.collect() == b.collect()
    short = "\n".join(",".join(r[:4]) for r in lines)
    with pytest.raises(ValueError, match="UnitPrice"):
        files.read_items(spark, _write(tmp_dir, "s.csv", short + "\n"))


def test_unreadable_cells_are_reported(spark, tmp_dir):
    bad = _write(tmp_dir, "b.csv", PURCHASES_CSV.replace(",1,2023-03-04 00:00:00", ",one,2023-03-04"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_purchases(spark, bad).collect()
    rows = files.read_purchases(spark, bad, mode="PERMISSIVE").collect()
    assert rows[0].quantity is None and rows[0].purchase_date == dt.date(2023, 3, 4)
    odd = _write(tmp_dir, "d.csv", PURCHASES_CSV.replace("2023-03-04 00:00:00", "soon"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_purchases(spark, odd).collect()
    assert files.read_purchases(spark, odd, mode="PERMISSIVE").first().purchase_date is None


def test_generated_tables_read_back(spark, tmp_dir):
    from basketry.sources import generate as G
    c, i = G.gen_customers(spark, 50, seed=3), G.gen_items(spark, seed=3)
    p = G.gen_purchases(spark, c, 200, seed=3)
    G.write_generated(c, i, p, tmp_dir)
    assert files.read_customers(spark, f"{tmp_dir}/customers").count() == 50
    assert files.read_items(spark, f"{tmp_dir}/items").count() == i.count()
    assert files.read_purchases(spark, f"{tmp_dir}/purchases").count() == p.count()


def test_missing_file_raises(spark, tmp_dir):
    with pytest.raises(AnalysisException):
        files.read_customers(spark, os.path.join(tmp_dir, "absent.csv")).collect()


def test_write_and_read_back(spark, tmp_dir):
    p = fx.purchases(spark)
    for fmt in ("parquet", "csv", "json"):
        out = os.path.join(tmp_dir, f"p_{fmt}")
        files.write_table(p, out, fmt)
        assert files.read_table(spark, out, fmt).count() == p.count()


def test_catalogue_rules(spark):
    # expected subcategories from the catalogue file of the reference data
    expected = {
        "Haircut (Women's)": "Haircut", "Balayage": "Coloring", "Highlights": "Coloring",
        "Hair Treatment (Keratin)": "Treatment", "Perm": "Styling", "Styling Gel": "Styling",
        "Makeup Remover": "Makeup", "Dry Shampoo": "Shampoo", "Hair Mask": "Treatment Products",
        "Frizz Control Serum": "Treatment Products", "Heat Protectant Spray": "Styling Products",
        "Face Wash": "Skincare", "Lipstick": "Other", "Facial": "Facial",
        "Conditioner (Deep)": "Conditioner", "Waxing (Legs)": "Waxing",
    }
    assert len(catalog.SERVICES) == 20 and len(catalog.PRODUCTS) == 49
    import pandas as pd
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(pd.DataFrame({"name": list(expected)}))
    got = {r.name: r.sub for r in df.select("name", catalog.classify("name").alias("sub")).collect()}
    assert got == expected


def test_catalogue_rules_in_spark(spark):
    names = catalog.SERVICES + catalog.PRODUCTS
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.cat, r.sub) for r in df.select(
        "name", catalog.category("name").alias("cat"), catalog.classify("name").alias("sub")).collect()}
    assert got["Styling Gel"] == ("Product", "Styling")
    assert got["Makeup Remover"] == ("Product", "Makeup")
    assert got["Dry Shampoo"] == ("Product", "Shampoo")
    assert got["Hair Mask"] == ("Product", "Treatment Products")
    assert got["Heat Protectant Spray"] == ("Product", "Styling Products")
    assert got["Face Wash"] == ("Product", "Skincare")
    assert got["Lipstick"] == ("Product", "Other")
    assert got["Makeup Application"] == ("Service", "Makeup")
    assert got["Hair Treatment (Deep Conditioning)"] == ("Service", "Treatment")
    counts = {}
    for cat, _ in got.values():
        counts[cat] = counts.get(cat, 0) + 1
    assert counts == {"Service": 20, "Product": 49}


def test_price_bounds(spark):
    df = spark.createDataFrame([("Service", "Coloring"), ("Product", "Other")], "c string, s string")
    lo, hi = catalog.price_bounds("c", "s")
    got = [(r.lo, r.hi) for r in df.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert got == [(60, 200), (10, 50)]


def test_load_merged(spark, tmp_dir):
    from basketry.plans.loading import load_merged
    c = _write(tmp_dir, "c2.csv", CUSTOMERS_CSV)
    i = _write(tmp_dir, "i2.csv", ITEMS_CSV)
    p = _write(tmp_dir, "p2.csv", PURCHASES_CSV)
    m = load_merged(spark, c, i, p)
    rows = m.collect()
    assert len(rows) == 3 and {r.employee_id for r in rows} == {"Emp03", "Unknown"}
    assert {r.item_name for r in rows} == {"Haircut (Women's)", "Styling Gel"}
    with pytest.raises(FileNotFoundError):
        load_merged(spark, c, i, os.path.join(tmp_dir, "missing.csv"))
