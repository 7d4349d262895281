"""The per-operator queries over ``documents`` and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from basketry.llm import (bpe, collocations, cotrain, decontaminate, exact_dedup, fim, langid,
                          licenses, lm, mixing, quality, simhash, token_counts)
from basketry.llm.common import crc_mod, documents, table

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"),
         public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

LOWERED = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz')"""


@register("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, k=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        "component_id")


@register("op4_source_mixing")
def op4(spark, sf_dir):
    sized = table(mixing.sizes(documents(spark, sf_dir)), "mix-sizes")
    mixed = table(mixing.mix(sized, table(mixing.targets(sized), "mix-targets")), "mix-copies")
    out = sized.alias("s").join(mixed.alias("m"), F.expr(
        "s.doc_id <=> m.doc_id and s.source <=> m.source and s.size = m.size"))
    return out.select("s.doc_id", "s.size", "m.source_size", "m.target",
                      (F.col("m.copies") * F.col("s.size")).alias("taken"))


@register("op5_token_counts")
def op5(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), BYTE_BPE).withColumn(
        "over_limit", F.col("n_tokens") > 1024)


@register("op8_quality_rules")
def op8(spark, sf_dir):
    judged = quality.judge(documents(spark, sf_dir), RANKS, carry=["doc_id"])
    return judged.select("doc.doc_id", "m.*", "base_failed", "kept")


@register("op9_exact_dedup", sql=f"""
WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm""")
def op9(spark, sf_dir):
    return exact_dedup.groups(documents(spark, sf_dir), keep="max")


@register("op10_bpe_round_trip")
def op10(spark, sf_dir):
    coded = bpe.round_trip(documents(spark, sf_dir), BYTE_BPE)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op6_language_id")
def op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    found = langid.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op7_license_scan", sql=licenses.sql(LOWERED))
def op7(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


@register("op2_lm_scoring")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(True))
    found = lm.learn_and_score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


@register("op3_quality_classifier")
def op3(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.classify(documents(spark, sf_dir), labels)


@register("op11_fill_in_middle", sql=fim.sql())
def op11(spark, sf_dir):
    return fim.transform(documents(spark, sf_dir), seed=7, rate=100, spm=50, texts=False)


@register("op12_phrase_collocations", sql=collocations.sql(LOWERED))
def op12(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir), least=30, limit=2000)


@register("op13_decontamination", sql=decontaminate.sql(LOWERED))
def op13(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(documents(spark, sf_dir), items, n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated")
