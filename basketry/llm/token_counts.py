"""Token counts by a two-tier lookup of pre-token lengths.

A text's token count is the sum of the counts of its pre-tokens, each of
which is encoded on its own. The first tier is a compact table of frequent
pre-tokens and their counts, made from a bounded sample of documents and
broadcast (at most ``TABLE`` entries); the second is a cache in each Python
worker that encodes what the table misses, at most ``CACHE`` entries, emptied
when full. Both only save work: a count never depends on them. No pre-token
is shuffled.

Defined results: a null text counts as empty (0 tokens, 0 bytes); rows are
independent, so repeats and null ids are kept; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow
from basketry.llm.pretokens import cutter, exact, library

#: Documents, about, whose pre-tokens fill the frequent table; pre-tokens that
#: one of them contributes; entries of the table; entries of a worker's cache.
SAMPLE = 512
PER_DOCUMENT = 2048
TABLE = 1 << 16
CACHE = 1 << 19
#: Characters of a pre-token that the table or a cache keeps, at most.
LONGEST = 256


class Lengths(dict):
    """Pre-token -> tokens; ``learn`` encodes what it does not have."""

    def __init__(self, path: str, known: dict[str, int]):
        super().__init__(known)
        self.known, self.encode = known, library(path).encode_batch_fast

    def __missing__(self, key):
        return 1                                 # a special token, the only int keys

    def learn(self, pieces: list) -> list[str]:
        """Encode the new ones; returns those that are too long to be kept."""
        distinct = set(pieces)
        new = [p for p in distinct if p not in self and isinstance(p, str)]
        if new:
            if len(self) + len(new) > CACHE + len(self.known):
                self.clear()
                self.update(self.known)
                new = [p for p in distinct if p not in self and isinstance(p, str)]
            self.update(zip(new, map(len, self.encode(new, add_special_tokens=False))))
        return [p for p in new if len(p) > LONGEST]

    def total(self, pieces: list) -> int:
        long = self.learn(pieces)
        n = sum(map(self.__getitem__, pieces))
        for p in long:
            del self[p]
        return n


def frequent(docs: DataFrame, path: str, sample: int = SAMPLE) -> dict[str, int]:
    """Pre-token -> tokens, of the most frequent pre-tokens of about ``sample``
    documents chosen by a hash of the text. Each sampled document sends its
    own counts, so nothing is shuffled and the driver gets a bounded amount."""
    n = docs.count()
    if not n:
        return {}
    every = max(1, n // sample)
    picked = docs.select(F.col("text").cast("string").alias("text")).where(
        F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0))

    def run(batches):
        cut = cutter(path)
        for b in batches:
            for t in b.column(0):
                # a hash cannot tell copies apart; a copied text counts again, harmlessly
                top = Counter(p for p in cut.pieces(t.as_py())
                              if isinstance(p, str) and len(p) <= LONGEST
                              ).most_common(PER_DOCUMENT)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([[w for w, _ in top]], pa.list_(pa.string())),
                     pa.array([[c for _, c in top]], pa.list_(pa.int32()))], ["w", "c"])

    total: Counter = Counter()
    rows = map_arrow(picked, run, "w array<string>, c array<int>")
    for r in rows.limit(4 * sample).toLocalIterator():   # copies cannot swell the sample
        for w, c in zip(r["w"], r["c"]):
            total[w] += c
    words = [w for w, c in total.most_common(TABLE) if c > 1]
    encoded = library(path).encode_batch(words, add_special_tokens=False)
    return {w: len(e) for w, e in zip(words, encoded)}


def pack(known: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The table as three byte strings: texts, their lengths, token counts."""
    texts = [w.encode() for w in known]
    return (b"".join(texts), np.array([len(t) for t in texts], np.uint32).tobytes(),
            np.array(list(known.values()), np.uint32).tobytes())


def unpack(packed: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    raw, lengths, counts = packed
    ends = np.cumsum(np.frombuffer(lengths, np.uint32)).tolist()
    starts = [0, *ends[:-1]]
    return {raw[a:b].decode(): c for a, b, c in
            zip(starts, ends, np.frombuffer(counts, np.uint32).tolist())}


def count_tokens(docs: DataFrame, path: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(pack(frequent(docs, path, sample)))

    def run(batches):
        cut, lengths = cutter(path), Lengths(path, unpack(held.value))
        own = library(path).encode

        def count(text: str) -> int:
            if not text:
                return 0
            if not exact(text):
                return len(own(text, add_special_tokens=False))
            return lengths.total(cut.pieces(text))

        for b in batches:
            texts = b.column(1)
            n = np.fromiter((count(t.as_py()) for t in texts), np.int64, b.num_rows)
            size = np.fromiter((t.as_buffer().size if t.is_valid else 0 for t in texts),
                               np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n)],
                                             ["doc_id", "n_bytes", "n_tokens"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run,
                     f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
