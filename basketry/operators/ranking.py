"""Top-n and bottom-n lists (T2, T3, W5) with deterministic tie-breaks, and
positions in a global order (W6, A27).

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: every partition
keeps its own n best rows and only those reach the final task, so the
global sort never materialises. The rank is added afterwards over n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head(df: DataFrame, key: str, metric: str, n: int, descending: bool = True,
         key_descending: bool = False) -> DataFrame:
    """The first n rows by ``metric`` (ties by ``key``) with a 1-based ``rank``."""
    m = F.col(metric).desc() if descending else F.col(metric).asc()
    k = F.col(key).desc() if key_descending else F.col(key).asc()
    top = df.select(key, metric).orderBy(m, k).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(m, k)))


def positions(df: DataFrame, order: list, out: str, partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the global ``order``, as column ``out``.

    Rows are dealt into ranges of the order and sorted inside them; a row's
    position is its place in its range plus the rows of the ranges before,
    which come from a join with one row per range. No range is gathered and
    nothing but those counts is added up in one place. Ties must be broken by
    ``order`` for the result to be deterministic.
    """
    from basketry.session import materialize
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .withColumn("_pid", F.spark_partition_id())
                        .withColumn("_mid", F.monotonically_increasing_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = (dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
             .select("_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
                     .alias("_shift")))
    return dealt.join(shift, "_pid").select(
        *df.columns, (F.col("_mid") + F.col("_shift")).cast("bigint").alias(out))
