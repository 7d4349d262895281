"""Null handling, one-hot encoding, ratios and rounding as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(col: str, values: Sequence[str], prefix: str | None = None) -> list[Column]:
    """One 0/1 column per value; a NULL input gives all zeros."""
    p = prefix or col
    return [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{p}_{v}")
            for v in values]


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def round_half_even(col: Column | str, places: int = 2) -> Column:
    """banker's rounding, as numpy and pandas round."""
    return F.bround(F.col(col) if isinstance(col, str) else col, places)


def scalar(agg: DataFrame) -> Column:
    """The single value of a one-row, one-column aggregate as a literal.

    One small job computes it; only that value reaches the driver. Used for
    global fills and statistics instead of a window over one partition, a
    cross join with a one-row frame, or a scalar subquery (which Spark
    re-executes for every reference).
    """
    row = agg.first()
    v = row[0] if row is not None else None
    return F.lit(v) if v is not None else F.lit(None).cast(agg.schema[0].dataType)


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Mean and population std of each column (one aggregate job) as literals
    keyed ``<col>__mean`` / ``<col>__std``."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(F.col(c).cast("double")).alias(f"{c}__mean"))
        aggs.append(F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std"))
    row = df.agg(*aggs).first()
    return {k: (F.lit(float(v)) if v is not None else F.lit(None).cast("double"))
            for k, v in row.asDict().items()}
