"""Load, clean and enrich the three CSV tables in one call."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from basketry.operators import sales
from basketry.sources import files


def load_merged(spark: SparkSession, customers_path: str, items_path: str,
                purchases_path: str, unknown: str = "Unknown") -> DataFrame:
    """Read the three files (explicit schemas), fill missing employee ids (P1),
    parse purchase dates (P2) and left-join items and customers (J1, J2).
    A missing file raises ``FileNotFoundError`` naming it."""
    frames = []
    for reader, path in ((files.read_customers, customers_path), (files.read_items, items_path),
                         (files.read_purchases, purchases_path)):
        try:
            df = reader(spark, path)
            df.schema  # resolve the relation now: a missing path fails here
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                raise FileNotFoundError(f"input file not found: {path}") from e
            raise
        frames.append(df)
    customers, items, purchases = frames
    return sales.merged(sales.fill_employee(purchases, unknown), items, customers)
