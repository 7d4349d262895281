"""Quality classifier by co-training of two views.

The text view sees what is written (hashed words and punctuation runs), the
page view sees the metadata and layout of the document (source, language,
length, lines, shares of capitals, digits, symbols and space). Each view has
a logistic classifier. In every round each view scores all unlabelled
documents; those it is surest of, in the proportion of the classes, are a
``GIVEN`` share found by a histogram of all scores, and a fresh draw from them
joins the other view's training set. Both views are then calibrated on labelled
rows that no fit has seen, and the calibrated log odds are combined, by a last
logistic fit on those rows, into one score for every document.

Both views of every whole text are written once (bucket numbers and counts);
rounds and scoring read that table. A fit runs in one task on a bounded set: at
most ``LABELLED`` labelled rows, chosen by hash, and ``DRAWN`` pseudo-labelled
ones a view and round, both also bounded in numbers (the bounds are parameters). Nothing but weights,
thresholds and histograms of a fixed size comes to the driver.

Defined results: a null text counts as empty; null metadata is a value of its
own; labels with a null id or quality are not used, and where a doc_id has
several labels their majority counts (a tie is 0); a doc_id that repeats in
the documents has that label in each of its rows, and one of them is fitted;
without labels of both classes every document scores 0.5 and is kept; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow, table

LABELLED = 6000
#: Pseudo-labelled rows that a view gets in one round, at most.
DRAWN = 3000
#: Numbers of the text view of all labelled rows of a fit, and of the rows that a
#: view gets in one round for one class, at most; long texts make for fewer rows.
LABELLED_SIZE, DRAWN_SIZE = 2_000_000, 300_000
ROUNDS = 3
#: Share of the unlabelled documents that a view is surest of.
GIVEN = 0.1
#: Log odds that a sure document has at least, and what a pseudo-label counts.
SURE, PSEUDO = 1.0, 0.3
#: Histogram of log odds: their largest size and the steps in one unit.
TOP, STEPS = 20, 50
TEXT_DIM = 1 << 13
PAGE_DIM = 1 << 9
#: Labelled rows, of a hundred, kept for calibration.
CALIBRATE = 25
_TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")


# ---------------------------------------------------------------- views
def text_view(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the content's hashed tokens; ``TEXT_DIM`` at most."""
    counts = Counter(_TOKENS.findall(text.lower()))
    at = np.fromiter((zlib.crc32(t) % TEXT_DIM for t in counts), np.int64, len(counts))
    c = np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts))) if counts else at
    at = np.flatnonzero(c)
    return at.astype(np.uint16), c[at].astype(np.uint32)


def page_view(text: bytes, source, lang, n_chars) -> np.ndarray:
    """Buckets of the metadata and layout, one for each property."""
    n = max(1, len(text))
    lines = text.count(b"\n") + 1
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda c: int(16 * (c / n) ** 0.5)
    capitals, digits = codes[65:91].sum(), codes[48:58].sum()
    letters = capitals + codes[97:123].sum() + codes[128:].sum()
    space = codes[9:14].sum() + codes[32]
    found = (("source", source), ("lang", lang),
             ("chars", None if n_chars is None else int(2 * np.log1p(max(0, n_chars)))),
             ("bytes", int(2 * np.log(n))), ("lines", int(2 * np.log(lines))),
             ("line", int(3 * np.log(n / lines + 1))), ("capitals", share(capitals)),
             ("digits", share(digits)), ("space", share(space)),
             ("symbols", share(n - letters - digits - space)),
             ("beyond", share(codes[128:].sum())))
    return np.array([zlib.crc32(f"{k}={v}".encode()) % PAGE_DIM for k, v in found], np.uint16)


# ---------------------------------------------------------------- logistic fits
class Sparse:
    """Rows of (buckets, values), one after another."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.n = len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.at, self.value = at.astype(np.int64), value

    @classmethod
    def dense(cls, rows: np.ndarray) -> Sparse:
        n, width = rows.shape
        return cls(np.full(n, width), np.tile(np.arange(width), n), rows.ravel())

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=self.n)

    def back(self, e: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * e[self.row], minlength=dim)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, dim: int,
             start: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Weights and, last, the bias; Adam on all rows, a little shrinkage."""
    w = np.zeros(dim + 1) if start is None else start.copy()
    m, v, total = np.zeros(dim + 1), np.zeros(dim + 1), max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        e = weight * (sigmoid(x.times(w[:-1]) + w[-1]) - y) / total
        g = np.concatenate((x.back(e, dim) + 1e-5 * w[:-1], [e.sum()]))
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def logit(x: Sparse, w: np.ndarray) -> np.ndarray:
    return x.times(w[:-1]) + w[-1]


def combine(odds: np.ndarray, y: np.ndarray):
    """(weights of each view's own calibration, of their combination) from the
    log odds of both views, rows x 2, and the labels."""
    odds, ones = np.clip(odds, -TOP, TOP), np.ones(len(y))
    platt = [logistic(Sparse.dense(odds[:, k:k + 1]), y, ones, 1, np.array([1.0, 0.0]), 200)
             for k in (0, 1)]
    both = np.stack([platt[k][0] * odds[:, k] + platt[k][1] for k in (0, 1)], 1)
    return platt, logistic(Sparse.dense(both), y, ones, 2, np.array([0.5, 0.5, 0.0]), 200)


# ---------------------------------------------------------------- views on Spark
def views(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number), mark (a hash of the id and both views), at and c
    (text view: buckets and counts), page (page view): packed numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, pages = [], []
            for t, s, g, n in zip(b.column(2), *(b.column(i).to_pylist() for i in (3, 4, 5))):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                texts.append(text_view(text))
                pages.append(page_view(text, s, g, n).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in texts], pa.binary()),
                 pa.array([c.tobytes() for _, c in texts], pa.binary()),
                 pa.array(pages, pa.binary())], ["doc_id", "row", "at", "c", "page"])

    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), *[
        F.col(c).cast(t).alias(c) for c, t in (("text", "string"), ("source", "string"),
                                               ("lang", "string"), ("n_chars", "bigint"))])
    return map_arrow(own, run, f"doc_id {kind}, row bigint, at binary, c binary, page binary"
                     ).withColumn("mark", F.xxhash64("doc_id", "at", "c", "page"))


def _packed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in each row, all numbers) of a column of packed numbers."""
    rows = column.to_pylist()
    width = np.dtype(kind).itemsize
    return (np.array([len(r) // width for r in rows], np.int64),
            np.frombuffer(b"".join(rows), kind))


def sparse_views(b) -> list[Sparse]:
    """Both views of a batch or table with at, c and page: damped counts of
    length 1, and ones."""
    sizes, at = _packed(b.column("at"), np.uint16)
    v = np.log1p(_packed(b.column("c"), np.uint32)[1])
    text = Sparse(sizes, at, v)
    length = np.sqrt(np.bincount(text.row, weights=v * v, minlength=text.n))
    text.value = v / length[text.row]
    sizes, at = _packed(b.column("page"), np.uint16)
    return [text, Sparse(sizes, at, np.ones(len(at)))]


# ---------------------------------------------------------------- fits on Spark
def labelled_rows(seen: DataFrame, labels: DataFrame, target: str, most: int):
    """The written tables (row, y) of all labelled rows of ``seen`` and of the
    bounded sample that is fitted, with views and ``calibrate``."""
    label = (labels.where(f"doc_id is not null and `{target}` is not null")
             .groupBy("doc_id").agg((F.avg(F.col(target).cast("double")) > 0.5)
                                    .cast("int").alias("y")))
    known = table(seen.select("doc_id", "row", "mark", _size()).join(label, "doc_id"),
                  "cotrain-known")
    chance = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1 << 30))
    # one row of a document; the hash bound leaves about twice as many as asked
    one = known.groupBy("doc_id", "y").agg(F.min(F.struct("mark", "row", "n")).alias("x"))
    bound = min(1 << 30, int((1 << 30) * 2 * most / max(1, one.count())) + 1)
    few = _within(one.where(chance < bound).select("*", "x.n", chance.alias("chance")),
                  ["chance", "doc_id"], most, LABELLED_SIZE)
    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")),
                  F.lit(100))
    few = few.select(F.col("x.row").alias("row"), "y", (fold < CALIBRATE).alias("calibrate"))
    sample = seen.select("row", "mark", "at", "c", "page").join(F.broadcast(few), "row")
    return known.select("row"), table(sample, "cotrain-sample")


def _size():
    return F.expr("octet_length(at) div 2").alias("n")


def _within(rows: DataFrame, order: list[str], most: int, size: int) -> DataFrame:
    """The first ``most`` rows, as far as their ``n`` add up to ``size`` (one row
    even so)."""
    first = rows.orderBy(*order).limit(most)
    upto = F.sum("n").over(Window.orderBy(*order))      # of ``most`` rows
    return first.withColumn("upto", upto).where((F.col("upto") <= size)
                                                | (F.col("upto") == F.col("n")))


def _fit(rows: DataFrame, start: list | None, last: bool):
    """Weights of both views after one round's fit, with ``last`` also those of
    calibration and combination. ``rows``: a bounded set with views, mark, y (a
    label or null), y_text and y_page (a label or pseudo-label or null),
    calibrate; one task."""
    schema = "name string, w array<double>"

    def run(batches):
        found = list(batches)
        if not found:
            return
        t = pa.Table.from_batches(found).sort_by("mark").combine_chunks()
        number = lambda n: t.column(n).to_numpy()
        y, calibrate = np.nan_to_num(number("y"), nan=-1), number("calibrate").astype(bool)
        fits = []
        both = sparse_views(t)
        for k, (x, dim, name) in enumerate(zip(both, (TEXT_DIM, PAGE_DIM), ("y_text", "y_page"))):
            own = np.nan_to_num(number(name), nan=-1)
            weight = ((own >= 0) & ~calibrate) * np.where(y >= 0, 1.0, PSEUDO)
            fits.append(logistic(x, np.maximum(own, 0), weight, dim, start and start[k]))
        out = {"text": fits[0], "page": fits[1]}
        if last:
            held = np.flatnonzero(calibrate & (y >= 0))
            if len(held) < 50 or len(set(y[held].tolist())) < 2:
                held = np.flatnonzero(y >= 0)
            odds = np.stack([logit(x, w) for x, w in zip(both, fits)], 1)[held]
            platt, out["join"] = combine(odds, y[held])
            out |= {"platt0": platt[0], "platt1": platt[1]}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(out)), pa.array([w.tolist() for w in out.values()],
                                           pa.list_(pa.float64()))], ["name", "w"])

    own = rows.select("mark", "at", "c", "page", "calibrate", *[
        F.col(c).cast("double").alias(c) for c in ("y", "y_text", "y_page")])
    return {r["name"]: np.array(r["w"]) for r in map_arrow(
        own.repartition(1), run, schema).collect()}


def log_odds(seen: DataFrame, fits: list[np.ndarray]) -> DataFrame:
    """row, mark, n (size of the text view), o_text, o_page: the log odds of both
    views for every row."""
    held = seen.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        fits = held.value
        for b in batches:
            odds = [np.clip(logit(x, w), -TOP, TOP) for x, w in zip(sparse_views(b), fits)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("mark"), b.column("n"), *map(pa.array, odds)],
                ["row", "mark", "n", "o_text", "o_page"])

    return map_arrow(seen.select("row", "mark", _size(), "at", "c", "page"), run,
                     "row bigint, mark bigint, n bigint, o_text double, o_page double")


def _step(view: str):
    return F.floor((F.col(view) + TOP) * STEPS).cast("int")


def thresholds(odds: DataFrame, view: str, prior: float, given: float):
    """((step, rows) of the surest negatives, of the surest positives): below and
    from which step of the log odds the surest ``given`` share of all rows lies,
    in the proportion of the classes."""
    counts = np.zeros(2 * TOP * STEPS + 1, np.int64)
    for r in odds.groupBy(_step(view).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["s"]] = r["n"]
    total = counts.sum()
    low = int(np.searchsorted(np.cumsum(counts), total * given * (1 - prior))) + 1
    high = int(np.flatnonzero(np.cumsum(counts[::-1])[::-1] >= total * given * prior)[-1])
    low, high = min(low, int((TOP - SURE) * STEPS)), max(high, int((TOP + SURE) * STEPS))
    return (low, int(counts[:low].sum())), (high, int(counts[high:].sum()))


def draw(odds: DataFrame, view: str, prior: float, given: float, most: int, turn: int) -> DataFrame:
    """(row, y): pseudo-labels by ``view``, at most ``most``, drawn by hash from
    all rows that it is surest of."""
    (low, n_low), (high, n_high) = thresholds(odds, view, prior, given)
    chance = F.pmod(F.xxhash64(F.lit(turn), F.lit(view), F.col("mark")), F.lit(1 << 30))
    out = None
    for y, sure, n, room in ((0, _step(view) < low, n_low, int(most * (1 - prior))),
                             (1, _step(view) >= high, n_high, int(most * prior))):
        bound = min(1 << 30, int((1 << 30) * 2 * room / max(1, n)) + 1)
        part = _within(odds.where(sure & (chance < bound)).withColumn("chance", chance),
                       ["chance", "mark", "row"], room, DRAWN_SIZE)
        part = part.select("row", F.lit(y).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


def co_train(seen: DataFrame, known: DataFrame, sample: DataFrame, prior: float,
             rounds: int = ROUNDS, given: float = GIVEN, drawn: int = DRAWN,
             after_round=None):
    """The model: weights of both views, of their calibrations and of the
    combination. ``seen``: the written views; ``known``: rows with a label;
    ``sample``: the labelled rows that are fitted; ``after_round`` is called
    with (round, weights of both views)."""
    none = F.lit(None).cast("int")
    rows = sample.withColumns({"y_text": F.col("y"), "y_page": F.col("y")})
    fits = None
    for turn in range(rounds + 1):
        w = _fit(rows, fits, turn == rounds)
        fits = [w["text"], w["page"]]
        if after_round:
            after_round(turn, fits)
        if turn == rounds:
            return fits, [w["platt0"], w["platt1"]], w["join"]
        odds = log_odds(seen, fits).join(known, "row", "left_anti")
        odds = table(odds, "cotrain-odds")
        for view, to, other in (("o_text", "y_page", "y_text"), ("o_page", "y_text", "y_page")):
            taken = rows.where(F.col("y").isNull() & F.col(to).isNotNull()).select("row")
            free = odds.join(F.broadcast(taken), "row", "left_anti") if turn else odds
            picked = draw(free, view, prior, given, drawn, turn).withColumnRenamed("y", to)
            fresh = (seen.select("row", "mark", "at", "c", "page").join(F.broadcast(picked), "row")
                     .withColumns({"y": none, other: none, "calibrate": F.lit(False)}))
            rows = rows.unionByName(table(fresh, "cotrain-drawn"))


def score(seen: DataFrame, model) -> DataFrame:
    """doc_id, p_text, p_page (calibrated views), score, kept for every row of
    the written views."""
    kind = seen.schema["doc_id"].dataType.simpleString()
    held = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in batches:
            odds, total = np.zeros((b.num_rows, 2)), np.zeros(b.num_rows)
            if model is not None:
                fits, platt, join = model
                for k, (x, w) in enumerate(zip(sparse_views(b), fits)):
                    odds[:, k] = platt[k][0] * np.clip(logit(x, w), -TOP, TOP) + platt[k][1]
                total = odds @ join[:2] + join[2]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(sigmoid(x)) for x in (*odds.T, total)]],
                ["doc_id", "p_text", "p_page", "score"])

    out = map_arrow(seen.select("doc_id", "at", "c", "page"), run,
                    f"doc_id {kind}, p_text double, p_page double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality",
             rounds: int = ROUNDS, labelled: int = LABELLED, drawn: int = DRAWN) -> DataFrame:
    """Fit on the bounded sample of labels and what the views label for each
    other, score every row of ``docs``."""
    seen = table(views(docs), "cotrain-views")
    known, sample = labelled_rows(seen, labels, target, labelled)
    n = {(r["y"], r["calibrate"]): r["count"]
         for r in sample.groupBy("y", "calibrate").count().collect()}
    if not (n.get((0, False)) and n.get((1, False))):
        return score(seen, None)
    positive = n.get((1, False), 0) + n.get((1, True), 0)
    return score(seen, co_train(seen, known, sample, positive / sum(n.values()), rounds,
                                drawn=drawn))
