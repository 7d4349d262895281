"""Benchmark decontamination by a broadcast set of test n-grams.

Items and documents are lower-cased (A-Z) and cut into words. The windows of an
item are its runs of ``n`` words; an item of fewer words is one window.

The distinct windows of all items are written, and go to every executor in two
forms: a bit set of the hashes of their first ``LEAD`` words, of at most
``MOST_BITS`` bits, that is part of the scan's expression, and a hash table for
the join, by a 64-bit hash of the window and then by its words. A document's
places are tried against the bit set inside its row; only the windows of those
that pass become rows, so a clean text is about one row of the join. The table
is broadcast up to ``MOST_BYTES``; a larger benchmark is joined by shuffles of
the windows that passed, with the same result. A full bit set lets more windows
pass and changes no result.

All rows of a document leave one task, so the grouping that follows is combined
there, and a passage that a third of all documents share is no hot key. Only
DataFrame functions are used.

Defined results: a null text has no words; items without words have no window;
rows that repeat a doc_id are judged apart; a null id is kept; items that share
an id count as one, items without an id hit words but are not listed; an empty
benchmark leaves every document clean; an empty table gives an empty result.
Only doc_id, text and item_id, text are read by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, table

#: Letters, digits and everything beyond ASCII make up words. Spark matches the
#: class as it is listed here three times faster than its complement.
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: A word with the separators after it, or those before the first word.
UNITS = f"^{GAPS}+|{WORDS}{GAPS}*"
#: First words of a window by which a place is tried.
LEAD = 4
#: Bits of the set of hashes, at least and at most, and bits for each window.
LEAST_BITS, MOST_BITS, BITS = 1 << 12, 1 << 20, 64
#: Bytes of the windows' table that is broadcast, at most.
MOST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS), F.lit(0))
    return F.transform(found, lambda w: ascii_lower(w))


def _lead(start: Column, width: int) -> Column:
    """Hash of the first words of a window, from the array ``codes``."""
    return F.xxhash64(*[F.get(F.col("codes"), start + j) for j in range(min(width, LEAD))])


def windows(items: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows of all items: lead (hash of the first ``LEAD`` words),
    width, gram (words joined by spaces), items (sorted distinct ids as strings),
    h (hash of the gram)."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"),
                       words(F.col("text")).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(n))
    rolled = cut.select("item_id", width.alias("width"), "words", F.explode(
        F.sequence(F.lit(1), F.size("words") - width + 1)).alias("at"))
    part = F.slice("words", F.col("at"), F.col("width"))
    # the hash of an array's elements is that of as many columns
    lead = F.xxhash64(F.transform(F.slice(part, 1, LEAD), lambda w: F.xxhash64(w)))
    grams = rolled.select("item_id", "width", F.array_join(part, " ").alias("gram"),
                          lead.alias("lead"))
    return grams.groupBy("lead", "width", "gram").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("h", F.xxhash64("gram"))


def _bits(grams: DataFrame, count: int) -> tuple[Column, int]:
    """A bounded bit set of the leads of windows, as a constant array of longs,
    and its number of bits."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS * count):
        size *= 2
    slots = grams.select(F.pmod("lead", F.lit(size)).alias("slot"))
    held = {r["w"]: r["b"] for r in slots.select(
        F.shiftright("slot", 6).cast("int").alias("w"),
        F.pmod("slot", F.lit(64)).cast("int").alias("i"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("b")).collect()}
    longs = ",".join(str(held.get(w, 0)) for w in range(size // 64))
    return F.split(F.lit(longs), ",").cast("array<bigint>"), size


def _passed(width: int, bits: Column, size: int) -> Column:
    """The windows of ``width`` words whose first words are in the bit set, of a
    row with ``words`` and ``codes`` (the words' hashes): at, width, gram."""
    def seen(i):
        slot = F.pmod(_lead(i, width), F.lit(size))
        return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")),
                        F.pmod(slot, F.lit(64)).cast("int")) == 1

    def window(i):
        return F.struct(i.alias("at"), F.lit(width).alias("width"), F.array_join(
            F.slice("words", i + 1, F.lit(width)), " ").alias("gram"))

    starts = F.sequence(F.lit(0), F.size("words") - width)
    return F.when(F.size("words") >= width, F.transform(F.filter(starts, seen), window))\
        .otherwise(F.array())


def hits(docs: DataFrame, grams: DataFrame, key: list[Column]) -> DataFrame:
    """``key``, row, n_words, spans (sorted distinct (first, end) of the windows
    of ``grams`` that occur), items (ids of the items they belong to): one row
    per row of ``docs``. ``grams``: the written table of ``windows``."""
    found = grams.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths"),
                      F.sum(F.octet_length("gram") + 64 + F.coalesce(F.aggregate(
                          "items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16),
                          F.lit(0))).alias("bytes")).first()
    bits, size = _bits(grams, found["n"])
    rows = docs.select(*key, F.monotonically_increasing_id().alias("row"),
                       words(F.col("text")).alias("words"))
    rows = rows.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    passed = [_passed(width, bits, size) for width in sorted(found["widths"])]
    none = F.array().cast("array<struct<at:int,width:int,gram:string>>")
    names = [c for c in rows.columns if c not in ("words", "codes")]
    tried = rows.select(*names, F.size("words").cast("bigint").alias("n_words"),
                        F.explode_outer(F.concat(none, *passed)).alias("w")).select(
        *names, "n_words", "w.*").withColumn("h", F.xxhash64("gram"))
    known = grams.select(F.col("h").alias("g_h"), F.col("gram").alias("g_gram"), "items")
    if (found["bytes"] or 0) <= MOST_BYTES:
        known = F.broadcast(known)
    met = tried.join(known, (F.col("h") == F.col("g_h")) & (F.col("gram") == F.col("g_gram")),
                     "left")
    span = F.struct(F.col("at").alias("first"), (F.col("at") + F.col("width")).alias("end"))
    return met.groupBy(*names, "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("g_h").isNotNull(), span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def merged(spans: Column) -> Column:
    """Sorted (first, end) spans as disjoint ones that do not touch."""
    def add(out, s):
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (s["first"] <= F.get(out, F.size(out) - 1)["end"])
        longer = F.struct(last["first"].alias("first"),
                          F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))
                      ).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<first:int,end:int>>"), add)


def covered(spans: Column) -> Column:
    """Words that lie in any of the sorted (first, end) spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["upto"], s["end"]).alias("upto"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], a["upto"]))).alias("n")),
        lambda a: a["n"])


def scan(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any
    occurrence of a window), spans, items (sorted ids), contaminated."""
    found = hits(docs, table(windows(items, n), "benchmark-windows"), [F.col("doc_id")])
    return found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "spans",
                        "items", (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "spans",
          share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` without the passages of ``items``, with all columns.

    ``remove="documents"`` leaves out the documents of whose words more than
    ``share`` are hit; ``remove="spans"`` keeps every document and takes out
    the hit words with the separators that follow them. Rows meet their spans
    by doc_id and the MD5 of the text."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove!r}")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    found = hits(docs, table(windows(items, n), "benchmark-windows"),
                 [F.col("doc_id").alias("hit_id"), digest.alias("hit_text")])
    found = found.where(F.size("spans") > 0)
    if remove == "documents":
        found = found.where(covered(F.col("spans")) > share * F.col("n_words"))
    found = table(found.groupBy("hit_id", "hit_text").agg(
        F.first("spans").alias("spans")), "benchmark-hits")
    taken = {c.lower() for c in docs.columns}
    hit_id, hit_text, spans, own, cut, lead = (
        _free(x, taken) for x in ("hit_id", "hit_text", "spans", "own", "cut", "lead"))
    found = found.select(F.col("hit_id").alias(hit_id), F.col("hit_text").alias(hit_text),
                         F.col("spans").alias(spans))
    keyed = docs.withColumn(own, digest)
    on = (keyed["doc_id"].eqNullSafe(found[hit_id])) & (keyed[own] == found[hit_text])
    if remove == "documents":
        return keyed.join(found, on, "left_anti").drop(own)
    units = F.regexp_extract_all(F.col("text").cast("string"), F.lit(UNITS), F.lit(0))
    # separators before the first word are a unit of their own
    before = F.when(F.col("text").cast("string").rlike(f"^{GAPS}"), 1).otherwise(0)
    kept = F.filter(units, lambda u, i: ~F.exists(
        F.col(cut), lambda s: (i - F.col(lead) >= s["first"]) & (i - F.col(lead) < s["end"])))
    joined = keyed.join(found, on, "left").withColumn(cut, merged(F.col(spans))).withColumn(
        lead, before)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`")
                           for c in docs.columns])


def _free(name: str, taken: set[str]) -> str:
    """A column name that no column of the input has."""
    while name in taken:
        name += "_"
    return name


def sql(lowered: str, n: int = 10) -> str:
    """The scan as DuckDB SQL; ``lowered`` is the text, A-Z lower-cased."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row,
  regexp_extract_all({lowered}, '{words}') AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
  regexp_extract_all({lowered}, '{words}') AS words FROM benchmark),
s AS (SELECT item_id, words, least(len(words), {n}) AS width FROM i WHERE len(words) > 0),
g AS (SELECT DISTINCT item_id, width, array_to_string(words[j:j + width - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS j FROM s)),
w AS (SELECT row, width, j, array_to_string(words[j:j + width - 1], ' ') AS gram
  FROM (SELECT row, words, width, unnest(range(1, len(words) - width + 2)) AS j
        FROM d, (SELECT DISTINCT width FROM g) x WHERE len(words) >= width)),
hits AS (SELECT w.row, w.j, w.width, g.item_id FROM w JOIN g ON w.width = g.width
  AND w.gram = g.gram),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (
  SELECT row, unnest(range(j, j + width)) AS p FROM hits) GROUP BY row),
named AS (SELECT row, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY row)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
  coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.row = c.row LEFT JOIN named m ON d.row = m.row"""
