"""A corpus pipeline over ``documents``: quality rules, exact dedup, SimHash
near-dedup, mixing sources to target weights, BPE encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import bpe, exact_dedup, mixing, quality, simhash
from basketry.llm.common import documents, table
from basketry.llm.queries import BYTE_BPE, RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.survivors(docs, RANKS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the smallest doc_id."""
    return exact_dedup.survivors(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id."""
    return simhash.survivors(docs, shingle=4, k=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    sized = table(mixing.sizes(docs), "mix-sizes")
    mixed = mixing.mix(sized, table(mixing.targets(sized), "mix-targets"))
    return mixing.repeat(docs, table(mixed, "mix-copies"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of every document of the mix."""
    return bpe.encode(docs, BYTE_BPE)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact),
          ("simhash near-dedup", near), ("mixing sources to target weights", mix),
          ("BPE encoding", encode)]

#: Fertility, SimHash, rounding draws and BPE are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
