"""Exact deduplication by 128-bit content hash.

Texts are equal when they are identical after lower-casing A-Z. Rows are
grouped by a 128-bit hash (MD5) together with the normalised bytes: the hash
leads the key, so rows meet by hash, and the bytes inside a hash group decide,
so two texts that collide stay apart. Only DataFrame functions are used.

Skew: the grouping is combined map-side, so a text that makes up a third of
all rows reaches the shuffle as one row per task.

Defined results: a null text counts as empty; a null id is smaller than any
other, so its row stays only where its whole group has null ids; rows that
repeat a doc_id with an equal text count in ``group_size`` and share
``kept``, while ``survivors`` returns one row per group; an empty table gives
an empty result. Only ``doc_id`` and ``text`` are read by ``groups``; other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, table


def normalised(df: DataFrame, text: str = "text"):
    return ascii_lower(F.coalesce(df[text], F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), normalised(docs).alias("norm")).select(
        "doc_id", F.md5(F.col("norm").cast("binary")).alias("h"), "norm")


def groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 of the normalised text. ``keep``: "min" (smallest id stays) or
    "max".

    The join that takes the answer back to the rows is on the hash alone;
    where two texts share a hash (a collision found by the byte comparison)
    those rows are joined on the bytes as well.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = _keyed(docs)
    merged = rows.groupBy("h", "norm").agg(best("doc_id").alias("keep_id"),
                                          F.count(F.lit(1)).alias("group_size"))
    merged = table(merged.select(
        "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        "keep_id", "group_size"), "exact")
    clash = merged.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    clash = table(clash, "exact-clash")
    alone = merged.join(clash, "h", "left_anti") if clash.take(1) else merged
    ids = rows.select("doc_id", "h")
    out = ids.join(alone, "h").select("doc_id", "keep_id", "group_size", "text_sha256")
    if clash.take(1):
        twins = (rows.join(clash, "h", "left_semi")
                 .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256)))
        out = out.unionByName(twins.select("doc_id", "h", "text_sha256")
                              .join(merged, ["h", "text_sha256"])
                              .select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct normalised text,
    with all columns of ``docs``. Ties of doc_id are broken by the other
    columns, in order."""
    names = docs.columns
    cols = [F.col(f"`{n}`") for n in names]
    rest = [c for n, c in zip(names, cols) if n not in ("doc_id", "text")]
    # the id leads the ordered struct; for the largest id a plain max, else a min
    row = F.struct(F.col("doc_id").alias("i"), *[c.alias(f"c{k}") for k, c in enumerate(rest)],
                   F.col("text").alias("t"))
    keyed = docs.select(F.md5(normalised(docs).cast("binary")).alias("h"),
                        normalised(docs).alias("norm"), row.alias("row"))
    best = {"min": F.min, "max": F.max}[keep]
    if keep == "min":  # a null id would sort first; put it last
        keyed = keyed.withColumn("row", F.struct(F.col("row.i").isNull().alias("n"),
                                                 *[F.col(f"row.{f}").alias(f) for f in
                                                   ["i", *[f"c{k}" for k in range(len(rest))],
                                                    "t"]]))
    out = keyed.groupBy("h", "norm").agg(best("row").alias("row"))
    back = {n: F.col(f"row.c{k}") for k, n in enumerate(
        n for n in names if n not in ("doc_id", "text"))}
    back |= {"doc_id": F.col("row.i"), "text": F.col("row.t")}
    return out.select(*[back[n].alias(n) for n in names])
