"""Language-model scoring with a gated recurrent network.

Tokens of a text are its words (A-Z lower-cased) and one end. Spark counts the
words of all training texts. The most frequent ones and, for all others, a
few tail buckets (by ending, letters and length) are the network's
vocabulary; inside a bucket a word has its smoothed share of the bucket, and
one share is left for words never seen, so probabilities of texts add up to
one. See ``gru`` for the network.

Words are split, counted and looked up with Arrow's functions, a batch of texts
at a time. Those of every text are looked up once and written as network ids of
two bytes. Training passes over every token of every training text once, data
parallel: ids are dealt by a hash to trainers, whose number follows the number
of training tokens and not the files, and to ``ROUNDS`` rounds. In each round
every trainer goes on from the same parameters and optimiser state with its
slice of the round; then both are averaged, weighted by tokens, along a
reduction tree, and only the average (a fixed number of bytes) comes to the
driver. A trainer's slice is put in the order of its hashes, so the result does
not depend on how the rows are laid out.

Scoring broadcasts the network and the ``HEAD`` most frequent words with
their counts. The counts of a text's other words come from a join on the
word, one row for each different word of a text; words above the head are
rare, so no key of that join is hot.

Defined results: a null text is empty and has one token, its end; rows are
scored apart, so repeats and null ids are kept (a null id counts as held
out); without training texts every word is unknown and the network is its
random start; an empty table gives an empty result. Only doc_id and text are
read.
"""

from __future__ import annotations

from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import gru
from basketry.llm.common import map_arrow, table

#: Most frequent words that are broadcast with their counts, at most.
HEAD = 1 << 17
#: Counts of words that a task holds, and their bytes, before it adds them up and
#: emits them.
HELD, HELD_BYTES = 1 << 20, 1 << 26
#: Bytes of a word that is broadcast, at most.
LONGEST = 256
#: Tokens that a task scores together, unless one text has more.
CHUNK = 4_000_000
#: Training tokens of a trainer, at least, unless there are fewer in all.
TRAINER = 4_000_000
#: Slices of the training tokens, each followed by an average; steps that a slice
#: should give, and the lanes that a step needs even so.
ROUNDS, STEPS, FEWEST = 8, 16, 64
#: Tokens of a text that are dealt together, at most.
PIECE = 1 << 16
#: Trainers' states that are added up together, and that come to the driver, at
#: most; a state is under half a megabyte.
FAN = 32
SMOOTH = 0.1
#: Tail buckets: 3 endings, ASCII or not, 4 lengths.
TAIL = 24
WORDS = gru.CLASSES * gru.MEMBERS - 1 - TAIL


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of an Arrow string array, one text after the other, and where each text's
    words begin and the last's end; lower-cases A-Z, splits at ASCII space."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = found.values.cast(pa.binary()), found.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)       # space at a text's ends leaves empty ones
    if full.true_count < len(words):
        before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        words, ends = words.filter(full), before[ends]
    return words, ends


def bucket(word: bytes) -> int:
    """Tail bucket of a word outside the vocabulary, 1 to TAIL."""
    last = word[-1]
    ending = 0 if 97 <= last <= 122 or last >= 128 else 1 if last in b".!?" else 2
    n = len(word)
    length = 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 10 else 3
    return 1 + (ending * 2 + (not word.isascii())) * 4 + length


def buckets(words: pa.Array) -> np.ndarray:
    """``bucket`` of each of an Arrow array of words."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[:ends[-1]]
    last, n = data[ends[1:] - 1], np.diff(ends)
    ending = np.where((last >= 97) & (last <= 122) | (last >= 128), 0,
                      np.where(np.isin(last, list(b".!?")), 1, 2))
    wide = np.maximum.reduceat(data, ends[:-1]) >= 128
    length = np.searchsorted([4, 7, 10], n)
    return (1 + (ending * 2 + wide) * 4 + length).astype(np.int32)


# ---------------------------------------------------------------- counts
def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``docs``."""

    def run(batches):
        held = []

        def emit():
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate(
                [("c", "sum")]).rename_columns(["word", "c"])
            held.clear()
            return found.to_batches(max_chunksize=1 << 16)

        for b in batches:
            word, c = words_of(b.column(0))[0].value_counts().flatten()
            held.append(pa.table({"word": word, "c": c}))
            if (sum(t.num_rows for t in held) >= HELD
                    or sum(t.nbytes for t in held) >= HELD_BYTES):
                yield from emit()
        if held:
            yield from emit()

    found = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run,
                      "word binary, c bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Word -> (id, count) of the head, and the counts of the buckets.

    ``total`` training tokens (N), ``distinct`` of them (V), both with the
    ends; ``tail_c`` and ``tail_v``: tokens and distinct words by bucket.
    """

    def __init__(self, head: list[tuple[bytes, int]], ends: int, total: int, distinct: int,
                 tail_c: np.ndarray, tail_v: np.ndarray):
        self.head, self.ends, self.total, self.distinct = head, ends, total, distinct
        self.tail_c, self.tail_v = tail_c, tail_v
        # share of a bucket's probability that one word with count c has, less the c
        self.tail_log = np.log10(tail_c + SMOOTH * (tail_v + 1))
        self.base_log = log10(total + SMOOTH * (distinct + 1))

    def counts(self) -> np.ndarray:
        """Training tokens by network id."""
        out = np.zeros(gru.CLASSES * gru.MEMBERS)
        out[gru.END] = self.ends
        out[1:1 + TAIL] = self.tail_c[1:]
        own = [c for _, c in self.head[:WORDS]]
        out[1 + TAIL:1 + TAIL + len(own)] = own
        return out

    def ids(self) -> dict[bytes, int]:
        """Network id of every head word."""
        return {w: 1 + TAIL + i if i < WORDS else bucket(w) for i, (w, _) in enumerate(self.head)}


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    """From the written table (word, c); ``ends``: training texts. The head is
    every word of at most ``LONGEST`` bytes from some count on, at most ``HEAD``."""
    # a histogram of the counts, some hundred rows, tells from which count on words fit
    step = F.floor(F.log2("c") * 32)
    least, room = None, HEAD
    short = counts.where(F.octet_length("word") <= LONGEST)
    for r in sorted(short.groupBy(step.alias("s")).agg(
            F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    top = [] if least is None else short.where(F.col("c") >= least).collect()
    head = sorted(((bytes(r["word"]), r["c"]) for r in top), key=lambda x: (-x[1], x[0]))
    known = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tail_c, tail_v = np.zeros(TAIL + 1), np.zeros(TAIL + 1)
    for r in counts.groupBy(_bucket(F.col("word")).alias("b")).agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        tail_c[r["b"]], tail_v[r["b"]] = r["c"], r["v"]
    for w, c in head[:WORDS]:
        tail_c[bucket(w)] -= c
        tail_v[bucket(w)] -= 1
    return Lexicon(head, ends, (known[0] or 0) + ends, known[1] + (ends > 0), tail_c, tail_v)


def _bucket(word: Column) -> Column:
    """``bucket`` as a column expression over binary words."""
    n = F.octet_length(word)
    last = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")
    ending = F.when(last.between(97, 122) | (last >= 128), 0).when(
        last.isin(*b".!?"), 1).otherwise(2)
    wide = F.when(F.hex(word).rlike("^([0-7].)*$"), 0).otherwise(1)
    length = F.when(n <= 4, 0).when(n <= 7, 1).when(n <= 10, 2).otherwise(3)
    return 1 + (ending * 2 + wide) * 4 + length


# ---------------------------------------------------------------- ids
def code(docs: DataFrame, learn: Column, lex: Lexicon) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (a number), learns, line (network
    ids, two bytes each, the end included), n_known, base_score and score as far
    as the head words go (the score without the network's part), and ``rare``,
    the other words with their bucket and number of places."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(
        (lex.ids(), dict(lex.head), lex.tail_log, lex.base_log, lex.ends))

    def run(batches):
        ids, head, tail_log, base_log, ends = held.value
        known_words = pa.array(list(head), pa.binary())
        counts = np.array(list(head.values()), np.float64)
        net_id = np.array(list(ids.values()), np.int16)
        # by head word: base term, and the word's share of its tail bucket
        base_of = np.log10(counts + SMOOTH) - base_log
        share_of = np.zeros(len(counts))
        share_of[WORDS:] = np.log10(counts[WORDS:] + SMOOTH) - tail_log[net_id[WORDS:]]
        end_term = log10(ends + SMOOTH) - base_log

        def coded(b):
            words, at = words_of(b.column(3))
            n = b.num_rows
            of = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
            found = pc.index_in(words, value_set=known_words)
            seen = found.is_valid().to_numpy(zero_copy_only=False)
            own, own_of = found.drop_null().to_numpy(), of[seen]
            # the other words, each once for a text
            other = words.filter(pc.is_null(found)).dictionary_encode()
            kind_of, kinds = buckets(other.dictionary), max(1, len(other.dictionary))
            number = other.indices.to_numpy()
            pairs, times = np.unique(of[~seen] * np.int64(kinds) + number,
                                     return_counts=True)
            net = np.empty(len(words), np.int16)
            net[seen], net[~seen] = net_id[own], kind_of[number]
            line = np.insert(net, at[1:], gru.END)
            sums = lambda values: np.bincount(own_of, values, n)
            rare = pa.StructArray.from_arrays(
                [other.dictionary.take(pa.array(pairs % kinds)), pa.array(kind_of[pairs % kinds]),
                 pa.array(times, pa.int64())], ["word", "bucket", "n"])
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(
                     (2 * (at + np.arange(n + 1))).astype(np.int32)), pa.py_buffer(line)]),
                 pa.array(np.bincount(own_of, minlength=n) + (ends > 0), pa.int64()),
                 pa.array(sums(base_of[own]) + end_term, pa.float64()),
                 pa.array(sums(share_of[own]), pa.float64()),
                 pa.ListArray.from_arrays(np.searchsorted(
                     pairs // kinds, np.arange(n + 1)).astype(np.int32), rare)],
                ["doc_id", "row", "learns", "line", "n_known", "base_score", "score", "rare"])

        yield from map(coded, batches)

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                           F.coalesce(learn, F.lit(False)).alias("learns"),
                           F.col("text").cast("string").alias("text"))
    return map_arrow(numbered, run, f"doc_id {kind}, row bigint, learns boolean, line binary, "
                     "n_known bigint, base_score double, score double, "
                     "rare array<struct<word:binary,bucket:int,n:bigint>>")


# ---------------------------------------------------------------- training
def pieces(coded: DataFrame) -> DataFrame:
    """(key, line): the ids of the texts to learn from, in pieces of ``PIECE``
    tokens at most, with a hash of the document, its ids and the piece's number."""
    cut = coded.where("learns").select("doc_id", "line", F.explode(F.expr(
        f"sequence(0, cast((octet_length(line) - 1) div {2 * PIECE} as int))")).alias("p"))
    return cut.select(F.xxhash64("doc_id", "line", "p").alias("key"), F.expr(
        f"substring(line, p * {2 * PIECE} + 1, {2 * PIECE})").alias("line"))


def _add(states: list[tuple]) -> tuple[int, int, int, np.ndarray]:
    """Sum of (trainer, weight, steps, weighted state), in the trainers' order."""
    states = sorted(states, key=lambda s: s[0])
    total = np.zeros_like(states[0][3])
    for s in states:
        total += s[3]
    return (states[0][0], sum(s[1] for s in states), max(s[2] for s in states), total)


def _train_round(slice_: DataFrame, state: np.ndarray, steps: int, rate: float, trainers: int):
    """(state, steps) after one round: every trainer goes on from ``state`` with
    its part of ``slice_`` (key, line), and their states are averaged."""
    sc = slice_.sparkSession.sparkContext
    held = sc.broadcast((state, steps, rate))
    schema = "trainer bigint, weight bigint, steps bigint, state binary"

    def run(batches):
        state, steps, rate = held.value
        own: dict[int, list] = {}
        for b in batches:
            for t, k, v in zip(*(c.to_pylist() for c in b.columns)):
                own.setdefault(t, []).append((k, v))
        for trainer, rows in own.items():
            lines = [np.frombuffer(v, np.int16) for _, v in sorted(rows)]
            n = sum(map(len, lines))
            model = gru.Model.start(np.ones(gru.CLASSES * gru.MEMBERS))
            optimiser = gru.Adam(model, rate)
            optimiser.resume(state, steps)
            gru.fit(model, optimiser, lines,
                    min(gru.LANES, max(FEWEST, n // (gru.WINDOW * STEPS))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([trainer]), pa.array([n]), pa.array([optimiser.n]),
                 pa.array([packed(n * optimiser.state())], pa.binary())],
                ["trainer", "weight", "steps", "state"])

    def packed(x):
        return x.astype(np.float32).tobytes()

    def rows_of(pdf):
        return [(int(t), int(w), int(s), np.frombuffer(x, np.float32).reshape(3, -1).astype(float))
                for t, w, s, x in zip(pdf["trainer"], pdf["weight"], pdf["steps"], pdf["state"])]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        t, w, s, x = _add(rows_of(pdf))
        return pd.DataFrame({"trainer": [t], "weight": [w], "steps": [s], "state": [packed(x)]})

    # more partitions than trainers, so that few share one
    dealt = slice_.select(F.pmod("key", F.lit(trainers)).alias("trainer"), "key", "line")
    found = map_arrow(dealt.repartition(2 * trainers, "trainer"), run, schema)
    n = trainers
    while True:
        n = -(-n // FAN)
        found = found.groupBy(F.pmod("trainer", F.lit(n))).applyInPandas(add, schema)
        if n <= FAN:
            break
    found = rows_of(found.toPandas())
    held.destroy()
    if not found:
        return state, steps
    _, weight, steps, total = _add(found)
    return total / weight, steps


def train(coded: DataFrame, lex: Lexicon, rate: float = 0.02, rounds: int = ROUNDS,
          least: int = TRAINER) -> gru.Model:
    """The network after one pass over the texts of ``coded`` that are learned
    from; the rate falls from round to round."""
    trainers = max(1, lex.total // least)
    own = pieces(coded)
    model = gru.Model.start(lex.counts())
    state, steps = gru.Adam(model).state(), 0
    for r in range(rounds):
        part = own.where(F.pmod(F.shiftright("key", 32), F.lit(rounds)) == r)
        state, steps = _train_round(part, state, steps, rate * (1 - 0.9 * r / rounds), trainers)
    return model.like(state[0])


# ---------------------------------------------------------------- scoring
def _network(coded: DataFrame, model: gru.Model) -> DataFrame:
    """``coded`` with n_tokens in place of line, and the network's part added to
    the score."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    held = coded.sparkSession.sparkContext.broadcast(model.flat())
    names = ["doc_id", "row", "n_known", "base_score", "score"]

    def run(batches):
        net = model.like(held.value)
        rows, lines, size = [], [], 0

        def emit():
            keep = pa.Table.from_batches(rows).combine_chunks()
            own = keep.column("score").to_numpy() + gru.score(net, lines)
            cols = [keep.column(n).combine_chunks() for n in names[:-1]]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(own), pa.array([len(x) for x in lines], pa.int64())],
                [*names, "n_tokens"])

        for b in batches:
            rows.append(b.select(names))
            lines += [np.frombuffer(x.as_buffer(), np.int16) for x in b.column("line")]
            size += sum(map(len, lines[-b.num_rows:])) if b.num_rows else 0
            if size >= CHUNK:
                yield emit()
                rows, lines, size = [], [], 0
        if lines:
            yield emit()

    return map_arrow(coded.select(*names, "line"), run,
                     f"doc_id {kind}, row bigint, n_known bigint, base_score double, "
                     "score double, n_tokens bigint")


def score(coded: DataFrame, counts: DataFrame, lex: Lexicon, model: gru.Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10)
    for every row of the written table ``coded``; ``counts``: the written table
    (word, c)."""
    rows = _network(coded, model)
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    met = rare.join(counts, "word", "left")
    own = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(SMOOTH))
    tail = F.element_at(F.array(*[F.lit(float(x)) for x in lex.tail_log]), F.col("bucket") + 1)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * (own - F.lit(lex.base_log))).alias("b"),
        F.sum(F.col("n") * (own - tail)).alias("s"))
    out = rows.join(sums, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_tokens", add("n_known", "k").alias("n_known"),
                      F.lit(lex.total).cast("bigint").alias("train_tokens"),
                      add("base_score", "b").alias("base_score"), add("score", "s").alias("score"))


def learn_and_score(docs: DataFrame, learn: Column) -> DataFrame:
    """Learn from the rows where ``learn`` holds, score every row."""
    training = docs.where(learn)
    counts = table(count_words(training), "lm-counts")
    lex = lexicon(counts, training.count())
    coded = table(code(docs, learn, lex), "lm-ids")
    return score(coded, counts, lex, train(coded, lex))
