"""License scans by diagonal voting.

Every rolling ``K``-word gram of every text is hashed and joined with the
grams of the license templates (a fixed, small table, so it is broadcast); an
exact comparison of the gram follows the hash join. A hit at word d of the
text and word t of the template lies on the diagonal d - t. Hits are kept as
one bitmap of t by text, template and diagonal, which loses none of them;
neighbouring diagonals (words inserted or left out) of one template are merged
into a span, over no more diagonals than the template has words. A span is
accepted when enough different grams of the template stand in it in the
template's order: its words are compared with the template's along the longest
run of hits in which d and t both grow. Phrases are templates that must stand
whole on one diagonal, so each of their places is one diagonal.

Only DataFrame functions are used. The counting is combined map-side, where
all grams of a text are, so the shuffle gets a row per text plus its few
diagonals. Texts are scanned whole.

Defined results: a null text counts as empty; rows are counted apart even
where doc_id repeats or is null; a text without a match has empty labels,
null places and score 0; an empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower

K = 3
#: Diagonals this close belong to one span.
GAP = 6
#: Share of a template's grams that a span must cover.
COVER = 0.7
#: Grams of a template, at most: one bit each.
MOST_GRAMS = 63
#: Letters, digits and everything beyond ASCII make up words.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose words stand consecutively.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices of public licenses, in lower case without punctuation.
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this "
     "file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
     "or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files the software to deal in the software without "
     "restriction"),
    ("mit", "released under the mit license"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_rows(phrases=PHRASES, notices=NOTICES, k: int = K) -> list[tuple]:
    """(template, label, base, grams, t, gram) for every gram of every template."""
    rows = []
    for number, (label, text) in enumerate([*phrases, *notices]):
        words = text.split()
        grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
        if not 0 < len(grams) <= MOST_GRAMS:
            raise ValueError(f"a template has 1 to {MOST_GRAMS} grams of {k} words, "
                             f"not {len(grams)}: {text!r}")
        rows += [(number, label, number < len(phrases), len(grams), t, g)
                 for t, g in enumerate(grams)]
    return rows


def diagonals(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """doc_id, row, n_words, template, label, base, grams, diagonal, mask (bit t
    for every hit): one row per text, template and diagonal that has hits, and
    one with null template for the rest of a text. Templates have at most 63
    grams."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(
        template_rows(phrases, notices, k),
        "template int, label string, base boolean, grams int, t int, t_gram string")
    grams = grams.withColumn("h", F.xxhash64("t_gram"))
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORDS),
                                 F.lit(0))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       words.alias("words"))
    # the last k - 1 grams of a text are short and match nothing
    gram = F.transform("words", lambda w, i: F.concat_ws(
        " ", w, *[F.get(F.col("words"), i + j) for j in range(1, k)]))
    rolled = rows.select("doc_id", "row", F.size("words").alias("n_words"), "words").select(
        "doc_id", "row", "n_words", F.posexplode_outer(gram).alias("d", "gram"))
    hashed = rolled.withColumn("h", F.xxhash64("gram"))
    hits = hashed.join(F.broadcast(grams), (hashed["h"] == grams["h"])
                       & (hashed["gram"] == grams["t_gram"]), "left")
    return hits.groupBy(
        "doc_id", "row", "n_words", "template", "label", "base", "grams",
        (F.col("d") - F.col("t")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("mask"))


def in_order(parts: Column, grams: Column) -> Column:
    """Most hits of ``parts`` (diagonal, mask) that follow each other in the text
    as in the template: the longest run with growing d and growing t."""
    places = F.sequence(F.lit(0), grams - 1)
    # t counts down among hits on one word, so that a run takes one of them
    hits = F.array_sort(F.flatten(F.transform(parts, lambda p: F.transform(
        F.filter(places, lambda t: F.getbit(p["mask"], t) == 1),
        lambda t: F.struct((p["diagonal"] + t).alias("d"), (-t).alias("back"))))))

    def longer(best, hit):
        t = -hit["back"]
        run = F.coalesce(F.array_max(F.slice(best, F.lit(1), t)), F.lit(0)) + 1
        return F.transform(best, lambda v, i: F.when((i == t) & (run > v), run).otherwise(v))

    return F.array_max(F.aggregate(hits, F.transform(places, lambda t: t * 0), longer))


def spans(votes: DataFrame, gap: int = GAP, cover: float = COVER, k: int = K) -> DataFrame:
    """doc_id, row, n_words, label, base, first (word the span starts at),
    covered (share of the template's grams): accepted spans, and one row with
    null label for every text."""
    text = ["doc_id", "row", "template"]
    by = Window.partitionBy(*text).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > gap, F.lit(True))
    merged = votes.withColumn("span", F.sum(
        F.when(F.col("base") | apart, 1).otherwise(0)).over(by))
    # a span may start at each diagonal and reaches over the template's words at most
    ahead = Window.partitionBy(*text, "span").orderBy("diagonal").rangeBetween(0, MOST_GRAMS + k - 2)
    reach = F.filter(F.collect_list(F.struct("diagonal", "mask")).over(ahead),
                     lambda p: p["diagonal"] - F.col("diagonal") < F.col("grams") + k - 1)
    need = F.when(F.col("base"), 1.0).otherwise(cover)
    seen = F.bit_count(F.aggregate("parts", F.lit(0).cast("bigint"),
                                   lambda m, p: m.bitwiseOR(p["mask"])))
    # few spans have enough different grams, and only their order is looked at
    share = F.when(seen >= need * F.col("grams"), in_order(F.col("parts"), F.col("grams"))
                   / F.col("grams"))
    tried = merged.withColumn("parts", reach).withColumn("covered", share).withColumn(
        "start", F.when(F.col("covered") >= need, F.col("diagonal")))
    found = tried.groupBy("doc_id", "row", "n_words", "template", "label", "base", "span").agg(
        F.min("start").alias("first"), F.max("covered").alias("covered"))
    ok = F.coalesce(F.col("covered") >= need, F.lit(False))
    return found.select(
        "doc_id", "row", "n_words", F.when(ok, F.col("label")).alias("label"),
        F.when(ok, F.col("base")).alias("base"),
        F.when(ok, F.greatest("first", F.lit(0))).alias("first"),
        F.when(ok, F.col("covered")).alias("covered"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of the
    phrases), first_word, last_word (their smallest and largest start),
    base_labels, labels (sorted, comma-joined), score (largest share of a
    template that was found)."""
    found = spans(diagonals(docs, phrases, notices))
    base = F.coalesce(F.col("base"), F.lit(False))

    def joined(which):
        return F.array_join(F.array_sort(F.collect_set(which)), ",")

    return found.groupBy("doc_id", "row", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word",
             "last_word", "base_labels", "labels", "score")


def sql(lowered: str) -> str:
    """The scan as DuckDB SQL; ``lowered`` is the text, A-Z lower-cased."""
    values = ",\n  ".join("({}, '{}', {}, {}, {}, '{}')".format(*r) for r in template_rows())
    gram = " || ' ' || ".join(f"words[i + {j}]" for j in range(1, K + 1))
    return f"""
WITH RECURSIVE grams(template, label, base, grams, t, gram) AS (VALUES
  {values}),
rows AS (SELECT doc_id, row_number() OVER () AS row,
  regexp_extract_all({lowered}, '{WORDS}') AS words FROM documents),
rolled AS (SELECT doc_id, row, i AS d, {gram} AS gram
  FROM (SELECT doc_id, row, words, unnest(range(len(words) - {K - 1})) AS i FROM rows)),
hits AS (SELECT row, template, label, base, grams, d - t AS diagonal, d, t,
    CASE WHEN base THEN 1.0 ELSE {COVER} END AS need FROM rolled JOIN grams USING (gram)),
votes AS (SELECT DISTINCT row, template, base, diagonal FROM hits),
marked AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER w > {GAP}, true)
  THEN 1 ELSE 0 END AS apart FROM votes WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)),
merged AS (SELECT row, template, diagonal, sum(apart) OVER (
  PARTITION BY row, template ORDER BY diagonal) AS span FROM marked),
-- what a span that starts at a diagonal reaches over the template's words
reach AS (SELECT s.row, s.template, s.span, s.diagonal AS start, h.label, h.base, h.grams, h.need,
    h.d, h.t
  FROM merged s JOIN merged m ON m.row = s.row AND m.template = s.template AND m.span = s.span
    AND m.diagonal >= s.diagonal
  JOIN hits h ON h.row = m.row AND h.template = m.template AND h.diagonal = m.diagonal
  WHERE h.diagonal - s.diagonal < h.grams + {K - 1}),
enough AS (SELECT row, template, span, start FROM reach GROUP BY row, template, span, start
  HAVING count(DISTINCT t) >= any_value(need) * any_value(grams)),
tried AS (SELECT r.* FROM reach r JOIN enough e ON r.row = e.row AND r.template = e.template
  AND r.span = e.span AND r.start = e.start),
-- runs of hits in which the place in the text and in the template both grow
run AS (SELECT row, template, span, start, d, t, 1 AS n FROM tried
  UNION SELECT c.row, c.template, c.span, c.start, h.d, h.t, c.n + 1
  FROM run c JOIN tried h ON h.row = c.row AND h.template = c.template AND h.span = c.span
    AND h.start = c.start AND h.d > c.d AND h.t > c.t),
longest AS (SELECT row, template, span, start, max(n) AS n FROM run
  GROUP BY row, template, span, start),
covered AS (SELECT l.*, g.label, g.base, l.n / g.grams::DOUBLE AS covered,
    CASE WHEN g.base THEN 1.0 ELSE {COVER} END AS need
  FROM longest l JOIN (SELECT DISTINCT template, label, base, grams FROM grams) g
    ON g.template = l.template),
kept AS (SELECT row, template, label, base, max(covered) AS covered,
    greatest(min(start) FILTER (WHERE covered >= need), 0) AS first
  FROM covered GROUP BY row, template, label, base, span HAVING max(covered) >= any_value(need))
SELECT any_value(r.doc_id) AS doc_id, any_value(len(r.words)) AS n_words,
  count(*) FILTER (WHERE k.base) AS n_base, min(k.first) FILTER (WHERE k.base) AS first_word,
  max(k.first) FILTER (WHERE k.base) AS last_word,
  coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label) FILTER (WHERE k.base), '')
    AS base_labels,
  coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label), '') AS labels,
  coalesce(max(k.covered), 0.0) AS score
FROM rows r LEFT JOIN kept k ON r.row = k.row GROUP BY r.row"""
