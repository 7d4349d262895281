"""Phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at sentence marks and line ends,
and pieces into words. Everything is counted by language. A phrase (1 to
``LONGEST`` words within a piece) with support ``f`` of ``least`` or more in a
language must reach, in one of the ``SHARDS`` shards at least, ``least`` times
that shard's share of the language. So:

1. Every shard (documents by a hash of their text) is mined completely at its
   lowered support, level by level: a phrase is counted only when both its
   parts of one word less were locally frequent. A shard's size is its bytes of
   the language; whatever the sizes, a phrase below its share in every shard is
   below ``least`` in all. Mining counts 64-bit hashes; two phrases that share
   one only add a candidate.
2. The union of the locally frequent phrases of a level is a bit set of
   ``BITS`` bits over their hashes, a fixed size, which is broadcast. A full
   set lets more candidates pass and changes no result.
3. All candidates are counted globally, by their words, and those below
   ``least`` go. Every count that a score needs is among them, since a part of
   a phrase is at least as frequent as the phrase.

Counting is combined in each task (``GATHERED`` places at a time) and again
before the shuffle, so a word or phrase that holds a third of all places is a
few rows per task. A piece is held whole, a text is not.

Scores use integers only (decimals where a product may pass 64 bits).

Defined results: a null or empty text has no words; a null lang is ``und``;
ids are not read, so repeated rows count as often as they occur; ties are
broken by the phrase; an empty table gives an empty result. Only text and lang
are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow, ship, table

#: What ends a piece, and what lies between words.
ENDS, SPACES = b".,;:!?\n\v\f\r", b" \t"
#: Words of a phrase, at most.
LONGEST = 4
#: Parts of the corpus that are mined on their own; each is mined by many tasks,
#: and more parts would lower the support, an absolute number, to nothing. Groups
#: of languages that share a lowered support, the least of theirs.
SHARDS, GROUPS = 2, 4096
#: Bits of a hash that are shuffled; the shard goes above them.
HASH = 48
#: Bits of the set of candidates of a level.
BITS = 1 << 26
#: Slots of the bit set that one group packs.
BLOCK = 1 << 19
#: Bytes of text that a task counts together (a quarter of it while it mines), that
#: it holds, and hashes that it counts together, about.
SLICE, HELD, GATHERED = 1 << 20, 8 << 20, 2 << 20
#: Groups into which a language's phrases are dealt before the last ranking.
SALTS = 256

_END = re.compile(b"[" + re.escape(ENDS) + b"]")
_GAP = b"\xff"                      # no byte of UTF-8 text
#: One pass over the bytes: lower case, ends of pieces to gaps, a tab to a space.
_MARKED = bytes(0xFF if i in ENDS else 32 if i in SPACES else i + 32 if 65 <= i <= 90 else i
                for i in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95                  # odd, so it has an inverse modulo 2 ** 64


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``_BASE`` and of its inverse, modulo 2 ** 64."""
    out = []
    with np.errstate(over="ignore"):
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            out.append(np.cumprod(row))
    return out[0], out[1]


def slices(text: bytes, size: int = SLICE):
    """A text in parts of ``size`` bytes or more, cut after a piece."""
    lo, n = 0, len(text)
    while n - lo > size:
        at = _END.search(text, lo + size)
        if at is None:
            break
        yield text[lo:at.end()]
        lo = at.end()
    yield text[lo:] if lo else text


class Chunk:
    """The words of texts of one language: where they start and end, the number
    of their piece and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes], seed: int):
        self.marked = _GAP.join(texts).translate(_MARKED)
        buf = np.frombuffer(self.marked, np.uint8)
        gap = buf == 255
        self.starts, self.ends = np.flatnonzero(np.diff(
            gap | (buf == 32), prepend=True, append=True)).reshape(-1, 2).T
        self.piece = np.cumsum(gap, dtype=np.int32)[self.starts]
        # a word's hash is a difference of prefix sums of bytes times powers, moved to power 0
        up, down = _powers(1 << max(SLICE.bit_length(), len(buf).bit_length()))
        sums = np.zeros(len(buf) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((buf + np.uint64(1)) * up[:len(buf)], out=sums[1:])
            own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.codes, self.seed = _mixed(own), np.uint64(seed)

    def hashes(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hash of the ``k``-word phrases that start at ``at``."""
        h = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h + self.codes[at + j]) * _ODD
            return _mixed(h ^ self.seed)

    def levels(self, sets: list[np.ndarray]):
        """(k, places) of the phrases whose parts of ``k`` - 1 words are in
        ``sets[k - 2]``, for k = 1 (all words) to one more than there are sets."""
        at = np.arange(len(self.codes))
        for k in range(1, len(sets) + 2):
            yield k, at
            if k <= len(sets):
                at = at[has(sets[k - 1], self.hashes(k, at))]
                # both parts are there when the next place is there too, in the same piece
                near, after = at[:-1], at[1:]
                at = near[(after - near == 1) & (self.piece[near] == self.piece[after])]

    def word(self, i: int) -> bytes:
        return self.marked[self.starts[i]:self.ends[i]]


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def counted(ids: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of each different ``k``-word phrase among ``at``, told
    apart by the words' numbers ``ids``."""
    key = ids[at]
    for j in range(1, k):
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = (key << 32) | ids[at + j]
    _, first, c = np.unique(key, return_index=True, return_counts=True)
    return at[first], c


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; ``bits`` has a power of two of them."""
    slot = h & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(
        np.uint8)) & 1 > 0


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _chunks(batches, size: int):
    """(lang, part, Chunk) over Arrow batches of (text, lang, part), of about
    ``size`` bytes each unless there are many languages."""
    held: dict[tuple, list[bytes]] = {}
    sizes: dict[tuple, int] = {}
    total = 0

    def emit(keys):
        for own in keys:
            yield own[0], own[1], Chunk(held.pop(own), _seed(own[0]))
            sizes.pop(own)

    for b in batches:
        langs, parts = b.column(1).to_pylist(), b.column(2).to_pylist()
        for i, t in enumerate(b.column(0)):
            own = (langs[i], parts[i])
            for piece in slices(t.as_buffer().to_pybytes(), size) if t.is_valid else ():
                held.setdefault(own, []).append(piece)
                sizes[own] = sizes.get(own, 0) + len(piece) + 1
                total += len(piece) + 1
                if sizes[own] >= size:
                    total -= sizes[own]
                    yield from emit([own])
                elif total >= HELD:
                    total = 0
                    yield from emit(list(held))
    yield from emit(list(held))


def _source(docs: DataFrame) -> DataFrame:
    """text, lang, shard, and part: the shard of the language's group."""
    text = F.col("text").cast("string")
    shard = F.pmod(F.xxhash64(text), F.lit(SHARDS)).cast("int")
    named = docs.select(text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
                        .alias("lang"), shard.alias("shard"))
    group = F.pmod(F.xxhash64("lang"), F.lit(GROUPS)).cast("int")
    return named.withColumn("part", group * SHARDS + F.col("shard"))


# ---------------------------------------------------------------- shards
def lowered_support(docs: DataFrame, least: int) -> np.ndarray:
    """By part, ``least`` times the part's share of its language's bytes,
    rounded up; of several languages in a group, the least."""
    sizes = table(_source(docs).groupBy("lang", "part").agg(
        F.sum(F.octet_length("text").cast("bigint")).alias("own")), "phrase-parts")
    total = sizes.groupBy("lang").agg(F.sum("own").alias("n"))
    wide = "cast({} as decimal(20,0))".format
    need = F.expr(f"cast(({wide(least)} * {wide('own')} + n - 1) div {wide('n')} as bigint)")
    out = np.full(GROUPS * SHARDS, least, np.int64)
    for r in sizes.join(total.where("n > 0"), "lang").groupBy("part").agg(
            F.min(F.greatest(need, F.lit(1))).alias("need")).collect():     # one row a part
        out[r["part"]] = min(least, r["need"])
    return out


def _local(docs: DataFrame, k: int, held) -> DataFrame:
    """(h,): hashes of the ``k``-word phrases that are frequent in a shard, below
    the shard's number. ``held``: (lowered support, bit sets)."""

    def run(batches):
        need, sets = held.value
        gathered: dict[int, list[np.ndarray]] = {}
        total = 0

        def emit():
            while gathered:
                part, hashes = gathered.popitem()
                h = np.concatenate(hashes)
                hashes.clear()
                h &= np.uint64((1 << HASH) - 1)
                h.sort()
                first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                h, c = h[first], np.diff(first, append=len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64) + (part % SHARDS << HASH)),
                     pa.array(c, pa.int64()), pa.repeat(pa.scalar(need[part], pa.int64()), len(c))],
                    ["h", "c", "need"])

        for lang, part, chunk in _chunks(batches, SLICE // 4):
            *_, (_, at) = chunk.levels(sets)
            if len(at):
                gathered.setdefault(part, []).append(chunk.hashes(k, at))
                total += len(at)
            if total >= GATHERED:
                yield from emit()
                total = 0
        yield from emit()

    rows = map_arrow(_source(docs).select("text", "lang", "part"), run,
                     "h bigint, c bigint, need bigint")
    return rows.groupBy("h").agg(F.sum("c").alias("c"), F.min("need").alias("need")).where(
        "c >= need").select("h")


def _bit_set(hashes: DataFrame) -> np.ndarray:
    """The bit set of a frame's ``h``: packed in blocks on Spark, BITS / 8
    bytes in all on the driver."""
    ship(hashes.sparkSession)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, bool)
        bits[pdf["slot"].to_numpy() % BLOCK] = True
        return pd.DataFrame({"block": [int(pdf["slot"].iloc[0]) // BLOCK],
                             "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = hashes.select(F.col("h").bitwiseAND(F.lit(BITS - 1)).alias("slot")).distinct()
    out = np.zeros(BITS // 8, np.uint8)
    for r in slots.groupBy(F.shiftright("slot", BLOCK.bit_length() - 1)).applyInPandas(
            pack, "block bigint, bits binary").collect():
        own = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] * len(own):(r["block"] + 1) * len(own)] = own
    return out


def mine(docs: DataFrame, least: int = 30) -> list[np.ndarray]:
    """The bit sets of the phrases that are frequent in a shard, by number of
    words."""
    sc = docs.sparkSession.sparkContext
    need = lowered_support(docs, least)
    sets: list[np.ndarray] = []
    for k in range(1, LONGEST + 1):
        held = sc.broadcast((need, sets))
        sets.append(_bit_set(_local(docs, k, held)))
        held.destroy()
    return sets


# ---------------------------------------------------------------- global counts
def count(docs: DataFrame, sets: list[np.ndarray], least: int = 30) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all candidates with f >= least,
    and with words 0 the number of all words of each language."""
    held = docs.sparkSession.sparkContext.broadcast(sets)

    def run(batches):
        sets = held.value

        def batch(lang, phrases, k, c):
            return pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(c)), phrases.cast(pa.string()),
                 pa.repeat(pa.scalar(k, pa.int32()), len(c)), pa.array(c, pa.int64())],
                ["lang", "phrase", "words", "c"])

        for lang, _, chunk in _chunks(batches, SLICE):
            known, ids = Numbers(), np.zeros(len(chunk.codes), np.int64)
            if len(ids):
                yield batch(lang, pa.array([b""]), 0, [len(ids)])
            for k, at in chunk.levels(sets[:LONGEST - 1]):
                at = at[has(sets[k - 1], chunk.hashes(k, at))]
                if k == 1:          # phrases of more words are made of these
                    words = map(chunk.word, at.tolist())
                    ids[at] = np.fromiter(map(known.__getitem__, words), np.int64, len(at))
                    words = pa.array(list(known), pa.binary())
                at, c = counted(ids, k, at)
                if len(at):
                    parts = [words.take(pa.array(ids[at + j])) for j in range(k)]
                    yield batch(lang, pc.binary_join_element_wise(*parts, b" "), k, c)

    source = _source(docs).select("text", "lang", F.lit(0).alias("part"))
    rows = map_arrow(source, run, "lang string, phrase string, words int, c bigint")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f")).where(
        (F.col("f") >= least) | (F.col("words") == 0))


def frequent(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Every phrase with its count (lang, phrase, words, f), and (lang, n), the
    words of each language."""
    counts = table(count(docs, mine(docs, least), least), "phrases")
    return counts.where("words > 0"), counts.where("words = 0").select(
        "lang", F.col("f").alias("n"))


# ---------------------------------------------------------------- scores
def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: every phrase of two words or more with its
    lowest-scoring cut."""
    parts = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"),
                                             parts.alias("p"), "words", cut)
    cuts = cuts.select("lang", "phrase", "a", "k",
                       F.array_join(F.slice("p", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("p", F.col("k") + 1, F.col("words") - F.col("k")),
                                    " ").alias("tail"))
    known = phrases.select("lang", "phrase", "f")
    both = (cuts.join(known.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"])
            .join(known.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]))
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div "
                   "(cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(
        score.alias("score"), "k", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def absorbed(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase): phrases that lie inside a longer one with at least
    ``percent`` of their count."""
    parts = F.split("phrase", " ")
    inner = phrases.where("words > 2").select("lang", "f", parts.alias("p"), "words").select(
        "lang", "f", "p", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("w"))
    inner = inner.select("lang", "f", "p", "w", F.explode(F.sequence(
        F.lit(1), F.col("words") - F.col("w") + 1)).alias("at"))
    most = inner.select("lang", "f", F.array_join(F.slice("p", F.col("at"), F.col("w")), " ")
                        .alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return most.join(phrases.where("words > 1"), ["lang", "phrase"]).where(
        wide("most") * 100 >= wide("f") * percent).select("lang", "phrase")


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each lang by score, a (both descending) and
    phrase, with their rank; first among the phrases of one of ``SALTS``
    groups, then among what those leave."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= limit)
    return first.drop("salt").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, least: int = 30, limit: int = 2000,
                 percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``limit``
    phrases of 2 to ``LONGEST`` words that no longer phrase absorbs."""
    phrases, totals = frequent(docs, least)
    best = scored(phrases).join(absorbed(phrases, percent), ["lang", "phrase"], "left_anti")
    return top(best, limit).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(lowered: str, least: int = 30, limit: int = 2000, percent: int = 80) -> str:
    """The collocations of ``documents`` as DuckDB SQL; ``lowered`` is the
    text, A-Z lower-cased."""
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array({lowered}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
p AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
        FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(words) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM p GROUP BY lang, phrase
  HAVING count(*) >= {least}),
c AS (SELECT lang, phrase, f AS a, k AS words, string_split(phrase, ' ') AS q FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, words, q, unnest(range(1, words)) AS k FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r,
  CAST((2000000::HUGEINT * u.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score FROM cuts u
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(q[1:u.k], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(q[u.k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (
  PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(q[i:i + v - 1], ' ') AS phrase, a AS most
  FROM (SELECT lang, q, a, v, unnest(range(1, words - v + 2)) AS i
        FROM c, (VALUES (2), (3)) z(v) WHERE v < words)),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inner_ i ON i.lang = c.lang
  AND i.phrase = c.phrase WHERE 100 * i.most::HUGEINT >= {percent} * c.a::HUGEINT),
left_ AS (SELECT b.* FROM best b ANTI JOIN gone g ON b.lang = g.lang AND b.phrase = g.phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score FROM left_ JOIN totals USING (lang) QUALIFY rank <= {limit}"""
