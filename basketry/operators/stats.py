"""Exact order statistics without gathering a column into one task.

``quantiles`` returns the linear-interpolation quantiles (numpy/pandas
``linear`` rule, Spark ``percentile``, DuckDB ``quantile_cont``). The values
are reduced to (value, count) pairs, combined map-side, so a value shared by a
third of all rows is one row; the pairs are dealt into ranges of the value,
the ranges' counts tell which of them hold the wanted ranks, and only there a
running count finds the values. Exact, one path for every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize


def quantiles(df: DataFrame, col: str, probs: Sequence[float],
              partitions: int | None = None) -> list[float | None]:
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
             .groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    pairs = materialize(pairs.repartitionByRange(n_parts, "x")
                        .withColumn("part", F.spark_partition_id()))
    # one row per range
    counts = sorted(tuple(r) for r in pairs.groupBy("part").agg(F.sum("n")).collect())
    total = sum(c for _, c in counts)
    if not total:
        return [None for _ in probs]
    wanted = {}
    for p in probs:
        pos = p * (total - 1)
        lo = math.floor(pos)
        wanted[p] = (lo, min(lo + 1, total - 1), pos - lo)
    ranks = sorted({r for lo, hi, _ in wanted.values() for r in (lo, hi)})
    value, before = {}, 0
    for part, c in counts:
        own = [r for r in ranks if before <= r < before + c]
        if own:
            upto = F.sum("n").over(Window.partitionBy("part").orderBy("x")) + F.lit(before)
            run = pairs.where(F.col("part") == part).select(
                "x", upto.alias("upto"), (upto - F.col("n")).alias("from"))
            hit = None
            for r in own:
                here = (F.col("from") <= r) & (F.col("upto") > r)
                hit = here if hit is None else hit | here
            for row in run.where(hit).collect():           # at most one per wanted rank
                value |= {r: row["x"] for r in own if row["from"] <= r < row["upto"]}
        before += c
    return [value[lo] + (value[hi] - value[lo]) * f for lo, hi, f in
            (wanted[p] for p in probs)]
