"""Small hand-made canonical frames."""

import datetime as dt
from decimal import Decimal

PURCHASE_SCHEMA = ("customer_id string, item_id string, quantity int, purchase_date date, "
                   "total_price decimal(18,2), employee_id string")
ITEM_SCHEMA = ("item_id string, item_name string, item_category string, "
               "item_subcategory string, unit_price decimal(18,2)")
CUSTOMER_SCHEMA = ("customer_id string, age int, gender string, registration_date date, "
                   "zip_code string, email_subscription boolean, sms_subscription boolean, "
                   "segment string")


def d(day, month=1, year=2023):
    return dt.date(year, month, day)


def money(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


def items(spark):
    rows = [
        ("I1", "Haircut (Men's)", "Service", "Haircut", money(30)),
        ("I2", "Facial", "Service", "Facial", money(80)),
        ("I3", "Shampoo (Dry)", "Product", "Shampoo", money(12)),
        ("I4", "Hair Mask", "Product", "Treatment Products", money(25)),
        ("I5", "Lipstick", "Product", "Other", money(15)),
    ]
    return spark.createDataFrame(rows, ITEM_SCHEMA)


def customers(spark):
    rows = [
        ("C1", 30, "F", d(1, 1, 2022), "90001", True, False, "Regular"),
        ("C2", None, "M", d(1, 1, 2022), "90002", False, True, "New"),
        ("C3", 50, None, d(1, 1, 2022), "90003", True, True, "Regular"),
        ("C4", 41, "F", d(1, 1, 2022), "90004", False, False, None),
    ]
    return spark.createDataFrame(rows, CUSTOMER_SCHEMA)


def purchases(spark):
    rows = [
        # Days 1, 2, 3, 5, 6 -> streak 3; two rows on day 1
        ("C1", "I1", 1, d(1), money(30), "Emp01"),
        ("C1", "I3", 2, d(1), money(24), None),
        ("C1", "I2", 1, d(2), money(80), "Emp02"),
        ("C1", "I1", 1, d(3), money(30), "Emp01"),
        ("C1", "I4", 1, d(5), money(25), None),
        ("C1", "I1", 1, d(6), money(30), "Emp03"),
        # One purchase only -> gap filled with the global max
        ("C2", "I3", 3, d(10), money(36), None),
        # Products only, one purchase before the epoch
        ("C3", "I3", 1, d(31, 12, 2022), money(12), None),
        ("C3", "I5", 1, d(20), money(15), None),
        # C3 buys an item missing from the catalogue
        ("C3", "IX", 1, d(21), money(5), None),
    ]
    return spark.createDataFrame(rows, PURCHASE_SCHEMA)
