"""Language identification by multinomial naive Bayes over hashed character
n-grams.

Texts are lower-cased and every run of non-letters becomes one space; their
1- to 3-grams are hashed into ``2**bits`` buckets. Training sums the bucket
counts of all labelled texts: a task adds up its own texts in numpy and emits
one row per language and bucket, which Spark sums. The matrix of log
probabilities (buckets x languages) is broadcast, and a text's counts, as a
sparse vector, are multiplied with it.

The broadcast is bounded: ``2**bits`` buckets times at most ``MAX_LANGS``
languages (an error beyond, nothing is left out silently).

Defined results: a null text or one without letters gives ``und`` with score
0, as does a training set without any label; rows are independent, so repeats
and null ids are kept; an empty table gives an empty result. Only the named
columns are read. Training rows with a null text or label do not count.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow, table

BITS = 15
ORDERS = (1, 2, 3)
MAX_LANGS = 256
SMOOTHING = 0.5
#: Languages whose counts a task holds before it emits them.
HELD = 32
#: Odd multipliers of the n-gram hash.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included; empty when the
    text has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    c = np.where(is_letter, c, np.uint32(32))[keep].astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) < n:
                break
            h = h[:len(c) - n + 1] * FACTORS[0] + c[n - 1:] * FACTORS[1]
            out.append(((h + np.uint64(n)) * FACTORS[2]) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def train(docs: DataFrame, lang: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, bucket, c): how often each bucket occurs in the texts of each
    language; bucket -1 counts the documents. Covers every row of ``docs``."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def emit():
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at - 1, pa.int64()),
                     pa.array(counts[at])], ["lang", "bucket", "c"])
            held.clear()

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                at = buckets(text.as_py(), bits)
                if name not in held:
                    if len(held) >= HELD:
                        yield from emit()
                    held[name] = np.zeros((1 << bits) + 1, np.int64)
                held[name][0] += 1
                held[name][1:] += np.bincount(at, minlength=1 << bits)
        yield from emit()

    rows = docs.select(F.col(lang).cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text")).where(
        "lang is not null and text is not null")
    found = map_arrow(rows, run, "lang string, bucket bigint, c bigint")
    return found.groupBy("lang", "bucket").agg(F.sum("c").alias("c"))


def matrix(counts: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities by bucket and language)."""
    langs = [r["lang"] for r in counts.where("bucket = -1").select("lang")
             .orderBy("lang").limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} distinct languages: the matrix to broadcast "
                         "would be unbounded; clean the label column or raise MAX_LANGS")
    rows = counts.toPandas()              # at most MAX_LANGS * 2**bits rows
    at = {name: i for i, name in enumerate(langs)}
    c = np.zeros(((1 << bits) + 1, len(langs)))
    if len(rows):
        c[rows["bucket"].to_numpy() + 1, rows["lang"].map(at).to_numpy()] = rows["c"].to_numpy()
    prior = np.log(c[0] / c[0].sum()) if len(langs) else c[0]
    grams = c[1:] + SMOOTHING
    return langs, prior, np.log(grams / grams.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model, bits: int = BITS) -> DataFrame:
    """doc_id, lang_pred, score (posterior of that language) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, prior, logp = held.value
        for b in batches:
            names, scores = [], np.zeros(b.num_rows)
            for i, text in enumerate(b.column(1)):
                at = buckets(text.as_py(), bits)
                if not len(at) or not langs:
                    names.append(UNKNOWN)
                    continue
                counts = np.bincount(at, minlength=1 << bits)
                own = np.flatnonzero(counts)
                total = prior + counts[own] @ logp[own].astype(np.float64)
                best = int(total.argmax())
                names.append(langs[best])
                scores[i] = 1.0 / np.exp(total - total[best]).sum()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run,
                     f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, learn: Column, lang: str = "lang", bits: int = BITS) -> DataFrame:
    """Learn from the rows where ``learn`` holds, predict every row."""
    counts = table(train(docs.where(learn), lang, bits), "langid-counts")
    return predict(docs, matrix(counts, bits), bits)
