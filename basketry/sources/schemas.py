"""Explicit schemas of the three canonical tables (no inference at read time)."""

from pyspark.sql import types as T

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("registration_date", T.DateType(), True),
    T.StructField("zip_code", T.StringType(), True),
    T.StructField("email_subscription", T.BooleanType(), True),
    T.StructField("sms_subscription", T.BooleanType(), True),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("item_name", T.StringType(), True),
    T.StructField("item_category", T.StringType(), True),
    T.StructField("item_subcategory", T.StringType(), True),
    T.StructField("unit_price", T.DecimalType(18, 2), True),
])

PURCHASES = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("item_id", T.StringType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("purchase_date", T.DateType(), True),
    T.StructField("total_price", T.DecimalType(18, 2), True),
    T.StructField("employee_id", T.StringType(), True),
])

# Purchases as stored in CSV: the date may carry a time part, parsed after the read.
PURCHASES_RAW = T.StructType([
    f if f.name != "purchase_date" else T.StructField("purchase_date", T.StringType(), True)
    for f in PURCHASES.fields
])

# Column names of the CSV files written by the data generator, in file order.
CSV_HEADERS = {
    "customers": ["CustomerID", "Age", "Gender", "RegistrationDate", "ZipCode",
                  "EmailSubscription", "SMSSubscription"],
    "items": ["ItemID", "ItemName", "ItemCategory", "ItemSubcategory", "UnitPrice"],
    "purchases": ["CustomerID", "ItemID", "Quantity", "PurchaseDate", "TotalPrice",
                  "EmployeeID"],
}
