"""Recommendation.

Two scorers share the masking, ranking and evaluation logic:

* popularity (deterministic, the cold-start fallback): score = total quantity
  of the item over active users;
* latent: vectors of width embedding_dim from the scaled user-item matrix, by
  linear reconstruction (``reconstruct``) or MLlib ALS with implicit
  preferences; a requested user's vector is multiplied with the items' vectors,
  blocks of near items by falling bound, as far as the bounds leave a chance.

Top-k of unseen items by rank gaps
----------------------------------
For a score shared by all users the items have one global ranking. If a user
has bought the items at ranks r_1 < r_2 < ..., then r_i - i unseen items stand
before the i-th of them, so the t-th unseen item has rank
``t + count(i : r_i - i < t)``. Only those counts are needed, one aggregate
over the history; nothing is expanded, and no history is removed row by row.
Histories are numbered within ranges of ``SPAN`` ranks, with the counts of
the ranges before, so a customer with a large part of all rows is many small
groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry import session
from basketry.operators import interactions as I
from basketry.operators import ranking
from basketry.session import materialize

#: Ranks that one group of a user's history covers, at most.
SPAN = 4096
#: First ranks that are broadcast with their items.
HEAD = 1 << 16


# ---------------------------------------------------------------- ranking
def global_rank(df: DataFrame, order: list, out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based position of every row in a global order (``ranking.positions``)."""
    return ranking.positions(df, order, out, partitions).withColumn(
        out, (F.col(out) + 1).cast("bigint"))


def ranked_popularity(active_matrix: DataFrame, all_matrix: DataFrame) -> DataFrame:
    """(rank, item_id, popularity), ties by item id; a written table, as
    the joins on it choose their kind by its real size."""
    pop = I.popularity(active_matrix, all_matrix)
    return materialize(global_rank(pop, [F.col("popularity").desc(), F.col("item_id").asc()],
                                   "rank"))


def top_popular(active_matrix: DataFrame, all_matrix: DataFrame, k: int = 5) -> DataFrame:
    """A27 top-k (``TakeOrderedAndProject``)."""
    pop = I.popularity(active_matrix, all_matrix)
    top = pop.orderBy(F.col("popularity").desc(), "item_id").limit(k)
    w = Window.orderBy(F.col("popularity").desc(), "item_id")
    return top.withColumn("rank", F.row_number().over(w))


def recommend_unseen_by_rank(requests: DataFrame, history: DataFrame, ranked: DataFrame,
                             k: int = 5, span: int = SPAN) -> DataFrame:
    """W3 + J7 + W5 for a score shared by all users: the first k items of
    ``ranked`` (rank, item_id) that are not in each requester's history.
    Output: customer_id, rank (1..k), item_id."""
    req = requests.select("customer_id").distinct()
    bought = (I.positive(history).select("customer_id", "item_id").distinct()
              .join(req, "customer_id", "left_semi")
              .join(ranked.select("item_id", F.col("rank").alias("_r")), "item_id"))
    placed = bought.withColumn("_range", F.floor((F.col("_r") - 1) / F.lit(span)))
    # per range of ranks: how many were bought before it, so how many unseen stand before it
    earlier = Window.partitionBy("customer_id").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    ranges = (placed.groupBy("customer_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
              .where(F.col("_range") * span - F.col("_before") < k)
              .select("customer_id", "_range", "_before"))
    place = Window.partitionBy("customer_id", "_range").orderBy("_r")
    gaps = placed.join(ranges, ["customer_id", "_range"]).withColumn(
        "_gap", F.col("_r") - F.col("_before") - F.row_number().over(place))
    counts = gaps.groupBy("customer_id").agg(*[
        F.count(F.when(F.col("_gap") < t, 1)).alias(f"_c{t}") for t in range(1, k + 1)])
    wanted = req.join(counts, "customer_id", "left").select(
        "customer_id", *[(F.lit(t) + F.coalesce(f"_c{t}", F.lit(0))).cast("bigint").alias(str(t))
                         for t in range(1, k + 1)])
    rows = materialize(wanted, "wanted-ranks").unpivot(
        ["customer_id"], [str(t) for t in range(1, k + 1)], "_t", "_rank")
    places = ranked.select(F.col("rank").alias("_rank"), "item_id")
    # nearly all requesters want the same few first ranks, which would be one key
    # of a join each; only who bought HEAD - k items wants a rank after the head
    head = rows.where(F.col("_rank") <= HEAD).join(
        F.broadcast(places.where(F.col("_rank") <= HEAD)), "_rank")
    tail = rows.where(F.col("_rank") > HEAD).join(places.where(F.col("_rank") > HEAD), "_rank")
    return head.unionByName(tail).select(
        "customer_id", F.col("_t").cast("int").alias("rank"), "item_id")


def with_names(recs: DataFrame, items: DataFrame) -> DataFrame:
    """Item names next to each ranked recommendation (rank order kept, V3)."""
    return recs.join(items.select("item_id", "item_name"), "item_id", "left")


# ---------------------------------------------------------------- evaluation
def actual_after(purchases: DataFrame, cut) -> DataFrame:
    """Distinct items each customer bought on/after the cut."""
    return (purchases.where(F.col("purchase_date") >= cut)
            .where(F.col("customer_id").isNotNull() & F.col("item_id").isNotNull())
            .select("customer_id", "item_id").distinct())


def precision_recall(recs: DataFrame, actual: DataFrame, k: int = 5) -> DataFrame:
    """R16 + X1: precision@k (divisor k) and recall@k per customer with actual
    purchases. ``recs`` holds (customer_id, item_id) rows, at most k per user."""
    n_act = actual.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = (recs.select("customer_id", "item_id").distinct()
            .join(actual, ["customer_id", "item_id"])
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("_hits")))
    j = n_act.join(hits, "customer_id", "left")
    hit = F.coalesce("_hits", F.lit(0)).cast("double")
    return j.select("customer_id", (hit / F.lit(float(k))).alias("precision"),
                    (hit / F.col("_n")).alias("recall"))


def precision_recall_shared(top: DataFrame, actual: DataFrame, k: int = 5) -> DataFrame:
    """R16 when every user receives the same list (W4 with a shared score):
    the k-row list is joined to the actual purchases, no per-user expansion."""
    n_act = actual.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = (actual.join(F.broadcast(top.select("item_id").limit(k).distinct()), "item_id")
            .groupBy("customer_id").agg(F.count(F.lit(1)).alias("_hits")))
    j = n_act.join(hits, "customer_id", "left")
    hit = F.coalesce("_hits", F.lit(0)).cast("double")
    return j.select("customer_id", (hit / F.lit(float(k))).alias("precision"),
                    (hit / F.col("_n")).alias("recall"))


def summarize(per_customer: DataFrame) -> DataFrame:
    """Mean precision and recall (0, 0 when nobody bought in the period)."""
    return per_customer.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_customers"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("mean_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"))


# ---------------------------------------------------------------- latent model
#: Ratings that one block of the fit holds, about.
BLOCK_RATINGS = 2_000_000
#: Seconds between two collections of what a running fit no longer needs.
COLLECT_SECONDS = 10
#: Items of a block, users of a tile (about), parts in which a block is dealt
#: to its tiles, and bounds of blocks that go into a plan, at most.
BLOCK_ITEMS, TILE_USERS, PARTS, BOUNDS = 8192, 4096, 32, 4096
#: Vectors of a leaf that the splits are taken from, and how many times more
#: blocks a user meets from round to round.
SAMPLE, GROWTH = 16, 4
NO_ITEM = (1 << 63) - 1
#: Rows of a user's history that are folded in together, about.
FOLD_ROWS = 4096
CHUNK_BYTES = 64 * 1024 * 1024
#: Users and items that are screened at once, so that their products stay in the cache.
SCREEN_USERS, SCREEN_ITEMS = 256, 2048
#: Blocks a user may want on average to meet them in tiles; else the items come as a stream
#: to groups of users and words of history, at most. Blocks of a file of that stream, bytes
#: that a task hands to Python at once (about).
NEAR, GROUP_USERS, GROUP_WORDS, FILE_BLOCKS, BATCH_BYTES = 2, 4096, 1 << 20, 4, 1 << 24


def fit_latent(scaled: DataFrame, rank: int = 32, seed: int = 42, max_iter: int = 10,
               reg: float = 0.01, alpha: float = 1.0):
    """Rank-r factorisation of the scaled matrix (``user_idx``, ``item_idx``,
    ``value``) with implicit preferences: every cell is fitted, a stored one as
    preference 1 with confidence 1 + alpha * value, any other as preference 0.
    This replaces the reference's reconstruction of scaled quantities, so its
    scores are preferences, not quantities. The number of blocks follows the
    number of ratings. Every iteration is checkpointed and what the ones before
    shuffled is collected while the fit runs, so the disk holds the shuffles of
    the last iterations, not those of all."""
    from pyspark.ml.recommendation import ALS

    from basketry.session import checkpoint_dir, collecting
    checkpoint_dir(scaled.sparkSession)
    blocks = max(1, -(-scaled.count() // BLOCK_RATINGS))
    blocks = max(blocks, int(scaled.sparkSession.sparkContext.defaultParallelism))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True,
              userCol="user_idx", itemCol="item_idx", ratingCol="value", seed=seed,
              numUserBlocks=blocks, numItemBlocks=blocks,
              nonnegative=False, checkpointInterval=1, coldStartStrategy="drop")
    with collecting(scaled.sparkSession, COLLECT_SECONDS):
        return als.fit(scaled.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"),
                                     F.col("value").cast("float")))


def fold_in(cells: DataFrame, item_factors: DataFrame, rank: int, reg: float = 0.01,
            alpha: float = 1.0) -> DataFrame:
    """R11 for users that were not fitted: (user_idx, features) from their
    cells (user_idx, item_idx, value) and the fitted ``item_factors`` (id,
    features): the same least squares that the fit solves for a user.

    The sums over a user's items are made in groups of about ``FOLD_ROWS``
    rows and added up, so a long history is never one group.
    """
    spark = cells.sparkSession
    width = rank * rank

    def gram(batches):
        total = np.zeros(width)
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                total += (y.T @ y).ravel()
        yield pd.DataFrame({"at": np.arange(width), "v": total})

    sums = (item_factors.select("features").mapInPandas(gram, "at int, v double")
            .groupBy("at").agg(F.sum("v").alias("v")).toPandas())      # rank * rank numbers
    every = np.zeros(width)
    every[sums["at"].to_numpy()] = sums["v"].to_numpy()
    every = every.reshape(rank, rank)
    sized = cells.groupBy("user_idx").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(FOLD_ROWS)).cast("bigint").alias("_parts"))
    met = (cells.join(sized, "user_idx")
           .join(item_factors.withColumnRenamed("id", "item_idx"), "item_idx")
           .withColumn("_part", F.pmod(F.xxhash64("item_idx"), F.col("_parts"))))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.stack(pdf["features"].to_numpy()).astype(np.float64)
        c = alpha * np.abs(pdf["value"].to_numpy(np.float64))
        liked = (pdf["value"].to_numpy() > 0).astype(np.float64)
        a = (y * c[:, None]).T @ y
        b = ((1 + c) * liked) @ y
        return pd.DataFrame({"user_idx": [pdf["user_idx"].iloc[0]], "n": [int(liked.sum())],
                             "a": [a.ravel()], "b": [b]})

    parts = met.groupBy("user_idx", "_part").applyInPandas(
        partial, "user_idx bigint, n bigint, a array<double>, b array<double>")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a = every + np.sum(np.stack(pdf["a"].to_numpy()), axis=0).reshape(rank, rank)
        a += reg * max(1, int(pdf["n"].sum())) * np.eye(rank)
        x = np.linalg.solve(a, np.sum(np.stack(pdf["b"].to_numpy()), axis=0))
        return pd.DataFrame({"user_idx": [pdf["user_idx"].iloc[0]],
                             "features": [x.astype(np.float32)]})

    return parts.groupBy("user_idx").applyInPandas(
        solve, "user_idx bigint, features array<float>")


class _Lists:
    """The best ``k`` of some users so far: by falling score, ties by item. ``words``, ``bits``,
    ``owner``: 64 items a word that a user (row ``owner``) may not get, by rising word."""

    def __init__(self, x: np.ndarray, k: int, words: np.ndarray, bits: np.ndarray,
                 owner: np.ndarray):
        self.x, self.k = x, k
        self.size = np.sqrt((x * x).sum(1))
        self.unit = (x / np.where(self.size > 0, self.size, 1)[:, None]).astype(np.float32)
        self.score = np.full((len(x), k), -np.inf)
        self.item = np.full((len(x), k), NO_ITEM, np.int64)
        order = np.argsort(words, kind="stable")
        self.words, self.bits, self.owner = words[order], bits[order], owner[order]

    def merge(self, row: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
        """Adds candidates (user's row, score, item)."""
        who, at = np.unique(row, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(who)), self.k), at])
        score = np.concatenate([self.score[who].ravel(), score])
        item = np.concatenate([self.item[who].ravel(), item])
        order = np.lexsort((item, -score, at))
        at, score, item = at[order], score[order], item[order]
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(len(who)))[at]
        own = place < self.k
        self.score[who[at[own]], place[own]] = score[own]
        self.item[who[at[own]], place[own]] = item[own]

    def meet(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, word: int) -> None:
        """Lets the users of ``rows`` meet items, the first of them bit 0 of ``word``. Products in
        single precision, with vectors made of length 1 at most, tell which items can enter a
        list; those are scored in double precision, one by one, so that a score does not depend
        on what is beside it."""
        top = np.sqrt((v * v).sum(1)).max()
        small = (v / (top if top > 0 else 1)).astype(np.float32)
        slack = (v.shape[1] + 8) * 2.0 ** -23       # of a product, with the roundings before it
        k, place = self.k, np.empty(len(self.x), np.int64)
        for lo in range(0, len(ids), SCREEN_ITEMS):
            part, width = small[lo:lo + SCREEN_ITEMS], min(SCREEN_ITEMS, len(ids) - lo)
            first = word + lo // 64
            begin, end = np.searchsorted(self.words, [first, first + -(-width // 64)])
            held, bit = np.nonzero(np.unpackbits(
                self.bits[begin:end].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1,
                bitorder="little"))
            owner, column = self.owner[begin + held], (self.words[begin + held] - first) * 64 + bit
            for start in range(0, len(rows), SCREEN_USERS):
                own = rows[start:start + SCREEN_USERS]
                near = self.unit[own] @ part.T
                if len(owner):
                    place[:] = -1
                    place[own] = np.arange(len(own))
                    here = place[owner] >= 0
                    near[place[owner[here]], column[here]] = -np.inf
                scale = self.size[own] * top
                floor = np.where(scale > 1e-280, self.score[own, -1] / np.where(
                    scale > 1e-280, scale, 1), -np.inf) - slack
                hit = np.flatnonzero(near.max(1) >= floor)
                if not len(hit):
                    continue
                near, floor, own = near[hit], floor[hit], own[hit]
                free = np.flatnonzero(floor == -np.inf)
                if len(free) and width > k:          # the k-th best of these items is a floor, too
                    floor[free] = np.partition(near[free], width - k, axis=1)[:, width - k] - 2 * slack
                row, at = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
                score = np.empty(len(row))
                step = max(1, CHUNK_BYTES // (16 * v.shape[1]))
                for c in range(0, len(row), step):
                    score[c:c + step] = np.einsum("ij,ij->i", self.x[own[row[c:c + step]]],
                                                  v[lo + at[c:c + step]])
                good = np.isfinite(score)
                self.merge(own[row[good]], score[good], ids[lo + at[good]])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(user's row, place) of all entries."""
        return np.nonzero(self.score > -np.inf)


def _words(words: list, bits: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, bits and the row of their owner of lists of words and bits (or None) by row."""
    sizes = [0 if w is None else len(w) for w in words]
    owner = np.repeat(np.arange(len(words)), sizes)
    return tuple(np.concatenate([np.asarray(x, np.int64) for x in own if x is not None and len(x)])
                 if len(owner) else np.zeros(0, np.int64) for own in (words, bits)) + (owner,)


def _score_tile(k: int, block_words: int):
    """cogroup body: the users of a tile (with the words of the items they bought) against the
    items of its block; the best k of each user by score, ties by item."""
    def fn(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(users) or not len(items):
            return pd.DataFrame({"user_idx": np.zeros(0, np.int64), "item_idx": np.zeros(0, np.int64),
                                 "score": np.zeros(0)})
        items = items.sort_values("place")
        x = np.stack(users["features"].to_numpy()).astype(np.float64)
        lists = _Lists(x, k, *_words(list(users["words"]), list(users["bits"])))
        lists.meet(np.arange(len(x)), items["item_idx"].to_numpy(),
                   np.stack(items["features"].to_numpy()).astype(np.float64),
                   int(items["block"].iloc[0]) * block_words)
        row, place = lists.rows()
        return pd.DataFrame({"user_idx": users["user_idx"].to_numpy()[row],
                             "item_idx": lists.item[row, place], "score": lists.score[row, place]})
    return fn


# ---------------------------------------------------------------- blocks of items
def split_tree(item_factors: DataFrame, leaves: int, items: int):
    """Splits of the space of vectors into about ``leaves`` parts with equally
    many items, as nested (column, value, below, above); None for one part. The
    columns are those of the vectors and their norm. The values are medians of a
    sample by a hash of the id, ``SAMPLE`` vectors a leaf; which blocks are
    scored depends on them, the result does not."""
    if leaves < 2:
        return None
    step = max(4, items // (SAMPLE * leaves))
    rows = item_factors.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("features").collect()
    if not rows:
        return None
    return _split(_with_norm(np.array([r["features"] for r in rows], np.float64)), leaves)


def _with_norm(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.sqrt((x * x).sum(1))])


def _split(x: np.ndarray, leaves: int):
    if leaves < 2 or len(x) < 2:
        return None
    column = int(np.argmax(x.var(0)))
    own = np.sort(x[:, column])
    value = float(own[len(own) * (leaves // 2) // leaves])
    if own[0] == value:                 # ties: the next value, so that no side is empty
        value = float(own[np.searchsorted(own, value, "right")]) if own[-1] > value else value
    below = x[:, column] < value
    if not below.any():
        return None
    return (column, value, _split(x[below], leaves // 2), _split(x[~below], leaves - leaves // 2))


def _leaves(x: np.ndarray, tree) -> np.ndarray:
    """The number of the leaf, from left to right, of every row of ``x``."""
    out, count = np.zeros(len(x), np.int64), 0
    stack = [(tree, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if node is None:
            out[rows] = count
            count += 1
            continue
        column, value, low, high = node
        below = x[rows, column] < value
        stack += [(high, rows[~below]), (low, rows[below])]
    return out


def place_items(item_factors: DataFrame, block_items: int = BLOCK_ITEMS,
                tree=None) -> DataFrame:
    """(item_idx, features, block, place): items by the leaf of ``tree`` and by
    falling norm of their vector inside it (without a tree all by norm), dealt
    into blocks of ``block_items`` that no leaf shares; a written table."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    items = item_factors.select(F.col("id").cast("bigint").alias("item_idx"), "features",
                                norm.alias("norm"))
    if tree is None:
        items = items.withColumn("leaf", F.lit(0).cast("bigint"))
    else:
        kind = items.schema["features"].dataType.simpleString()

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x = _with_norm(np.stack(pdf["features"].to_numpy()).astype(np.float64))
                    yield pdf.assign(leaf=_leaves(x, tree))

        items = items.mapInPandas(run, f"item_idx bigint, features {kind}, norm double, leaf bigint")
    placed = ranking.positions(items, [F.col("leaf"), F.col("norm").desc(), F.col("item_idx")], "at")
    if tree is not None:
        placed = materialize(placed, "items-in-order")
    before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("leaf").agg(F.min("at").alias("_start"), F.expr(
        f"cast(ceil(count(1) / {block_items}) as bigint)").alias("_blocks")).select(
        "leaf", "_start", F.coalesce(F.sum("_blocks").over(before), F.lit(0)).alias("_before"))
    own = F.col("at") - F.col("_start")
    return materialize(placed.join(F.broadcast(starts), "leaf").select(
        "item_idx", "features", "norm",
        (F.floor(own / F.lit(block_items)) + F.col("_before")).cast("bigint").alias("block"),
        F.pmod(own, F.lit(block_items)).cast("int").alias("place")), "placed-items")


@dataclass
class Boxes:
    """Per block: its number, the smallest and largest value of every column of
    its vectors, their largest norm and the smallest item. Blocks by that item.
    ``whole``: all values are whole numbers. ``most``: largest norm of all."""
    block: np.ndarray
    mid: np.ndarray
    half: np.ndarray
    norm: np.ndarray
    item: np.ndarray
    whole: bool
    most: float

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, blocks): what no item of the block scores above, with vectors
        ``x``; and for which rows scores are exact, so that nothing was added
        for rounding. Column by column, so a row's bounds do not depend on the
        rows beside it."""
        size = np.sqrt((x * x).sum(1))
        cap = size[:, None] * self.norm
        slack = cap * 1e-9 + 1e-12
        out = np.zeros_like(cap)
        for j in range(x.shape[1]):
            out += x[:, j, None] * self.mid[:, j] + np.abs(x[:, j, None]) * self.half[:, j]
        exact = self.whole & (x == np.floor(x)).all(1) & (size * self.most < 2.0 ** 50)
        np.minimum(out + np.where(exact[:, None], 0, slack), cap + slack, out=out)
        return out, exact

    def may(self, bound: np.ndarray, exact: np.ndarray, kth: np.ndarray,
            item: np.ndarray) -> np.ndarray:
        """(rows, blocks): whether the block can change a list that ends with ``kth`` and
        ``item``; equal scores go to the lower item."""
        return (bound > kth) | ((bound == kth) & (~exact[:, None] | (self.item <= item)))

    def only(self, block: int) -> Boxes:
        at = np.flatnonzero(self.block == block)
        return Boxes(self.block[at], self.mid[at], self.half[at], self.norm[at], self.item[at],
                     self.whole, self.most)


def block_boxes(placed: DataFrame) -> Boxes | None:
    """The ``Boxes`` of placed items: two vectors a block come to the driver."""
    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
        return pd.DataFrame({
            "block": [pdf["block"].iloc[0]], "lo": [x.min(0)], "hi": [x.max(0)],
            "norm": [pdf["norm"].max()], "item": [pdf["item_idx"].min()],
            "whole": [bool((x == np.floor(x)).all())]})

    rows = placed.groupBy("block").applyInPandas(
        box, "block bigint, lo array<double>, hi array<double>, norm double, item bigint, "
        "whole boolean").orderBy("item").collect()
    if not rows:
        return None
    lo, hi = (np.array([r[c] for r in rows], np.float64) for c in ("lo", "hi"))
    return Boxes(np.array([r["block"] for r in rows]), (lo + hi) / 2, (hi - lo) / 2,
                 np.array([r["norm"] for r in rows]), np.array([r["item"] for r in rows]),
                 all(r["whole"] for r in rows), max(r["norm"] for r in rows))


def _with_last(users: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """(user_idx, features, kth, item): score and item of the k-th of every user's list."""
    if best is None:
        return users.select("user_idx", "features", F.lit(float("-inf")).alias("kth"),
                            F.lit(NO_ITEM).alias("item"))
    last = best.groupBy("user_idx").agg(
        F.max(F.struct((-F.col("score")).alias("s"), "item_idx")).alias("_l"),
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    return users.join(last, "user_idx", "left").select(
        "user_idx", "features", F.coalesce(-F.col("_l.s"), F.lit(float("-inf"))).alias("kth"),
        F.coalesce("_l.item_idx", F.lit(NO_ITEM)).alias("item"))


def _chances(pdf: pd.DataFrame, boxes: Boxes):
    """Users in chunks, as (their numbers, bounds of all blocks, which can change their lists)."""
    step = max(1, CHUNK_BYTES // (32 * len(boxes.block)))
    for lo in range(0, len(pdf), step):
        part = pdf.iloc[lo:lo + step]
        bound, exact = boxes.bounds(np.stack(part["features"].to_numpy()).astype(np.float64))
        kth, item = part["kth"].to_numpy()[:, None], part["item"].to_numpy()[:, None]
        yield part["user_idx"].to_numpy(), bound, boxes.may(bound, exact, kth, item)


def next_blocks(users: DataFrame, best: DataFrame | None, boxes: Boxes, k: int, done: int,
                count: int) -> DataFrame:
    """(user_idx, block): of every user's blocks by falling bound, those after
    the first ``done``, at most ``count``, that can still change the list.
    ``best``: (user_idx, item_idx, score), the best k of the first ``done``."""
    held = users.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        boxes = held.value
        for pdf in batches:
            for ids, bound, may in _chances(pdf, boxes):
                users_, blocks_ = [], []
                for r in np.flatnonzero(may.sum(1) > 0):
                    order = np.argsort(-bound[r], kind="stable")[done:done + count]
                    order = order[may[r, order]]
                    users_.append(np.full(len(order), ids[r], np.int64))
                    blocks_.append(boxes.block[order])
                if users_:
                    yield pd.DataFrame({"user_idx": np.concatenate(users_),
                                        "block": np.concatenate(blocks_)})

    return _with_last(users, best, k).mapInPandas(run, "user_idx bigint, block bigint")


def wanted_blocks(users: DataFrame, best: DataFrame, boxes: Boxes, k: int) -> DataFrame:
    """(user_idx, home, wanted): a user's first block by falling bound, and how many of the
    others can still change the list of it, ``best``; users for whom that is none are left out."""
    held = users.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        boxes = held.value
        for pdf in batches:
            for ids, bound, may in _chances(pdf, boxes):
                home = np.argmax(bound, axis=1)
                may[np.arange(len(ids)), home] = False
                own = may.any(1)
                yield pd.DataFrame({"user_idx": ids[own], "home": boxes.block[home[own]],
                                    "wanted": may[own].sum(1)})

    return _with_last(users, best, k).mapInPandas(run, "user_idx bigint, home bigint, wanted bigint")


def block_bounds(placed: DataFrame, most: int = BOUNDS) -> tuple[list[float], int, int]:
    """Largest norms of stretches of blocks (at most ``most`` numbers, falling),
    the blocks of a stretch and the number of blocks."""
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    stretch = -(-blocks // most)
    rows = placed.groupBy(F.expr(f"block div {stretch}").alias("s")).agg(
        F.max("norm").alias("norm")).orderBy("s").collect()
    return [r["norm"] for r in rows], stretch, blocks


def needed_blocks(users: DataFrame, best: DataFrame, bounds: list[float], stretch: int,
                  blocks: int, k: int) -> DataFrame:
    """(user_idx, features, block): the blocks after the first whose items could
    still enter a user's list. ``best``: (user_idx, item_idx, score) of the
    first block. No item of a block scores more than the user's norm times the
    block's largest norm, and the bounds fall from block to block."""
    kth = best.groupBy("user_idx").agg(
        F.min("score").alias("_kth"), F.count(F.lit(1)).alias("_n"))
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    held = users.join(kth, "user_idx", "left").withColumn("_norm", norm)
    # a little more than the product, for rounding; equal scores are looked at
    may = F.filter(F.array(*[F.lit(float(b)) for b in bounds]),
                   lambda b: F.col("_norm") * b * (1 + 1e-9) + 1e-12 >= F.col("_kth"))
    last = F.when(F.coalesce(F.col("_n"), F.lit(0)) < k, F.lit(blocks - 1)).otherwise(
        F.least(F.size(may) * F.lit(stretch), F.lit(blocks)) - 1)
    return held.withColumn("_last", last).where("_last >= 1").select(
        "user_idx", "features", F.explode(F.expr("sequence(1L, cast(_last as bigint))"))
        .alias("block"))


def _with_seen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Users with the words and bits of their history."""
    if seen is not None:
        return rows.join(seen, "user_idx", "left")
    return rows.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("words", "bits")})


def _scored_tiles(rows: DataFrame, placed: DataFrame, seen: DataFrame | None,
                  groups: int | DataFrame, k: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The best k of every (user, block) of ``rows`` (user_idx, features, block).
    A tile is a block and one of ``groups`` groups of users: a number, or a table
    (block, groups)."""
    rows = _with_seen(rows, seen)
    if isinstance(groups, DataFrame):
        rows = rows.join(F.broadcast(groups), "block").withColumn(
            "tile", F.pmod(F.xxhash64("user_idx"), F.col("groups"))).drop("groups")
        wanted = groups.select("block", F.explode(F.expr("sequence(0L, groups - 1)")).alias("tile"))
    else:
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("user_idx"), F.lit(groups)))
        wanted = rows.select((F.col("block") + 0).alias("block"),
                             (F.col("tile") + 0).alias("tile")).distinct()
    # a block goes to the tiles that want it, in parts, as some are wanted by all
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    items = (placed.withColumn("part", F.pmod("place", F.lit(PARTS)))
             .join(wanted, ["block", "part"])
             .select("block", "tile", "item_idx", "features", "place"))
    return rows.groupBy("block", "tile").cogroup(items.groupBy("block", "tile")).applyInPandas(
        _score_tile(k, -(-block_items // 64)), "user_idx bigint, item_idx bigint, score double")


def _pack_items(batches):
    """One row a block: its number, items and vectors in the order of their places."""
    pdf = pd.concat([b.to_pandas() for b in batches]).sort_values("place")
    v = np.stack(pdf["features"].to_numpy()).astype("<f8")
    return pa.table({"block": pa.array([pdf["block"].iloc[0]], pa.int64()),
                     "ids": pa.array([pdf["item_idx"].to_numpy("<i8").tobytes()], pa.binary()),
                     "vectors": pa.array([v.tobytes()], pa.binary())})


#: Numbers of a group's users, packed: their own, vectors, first blocks, lists, history.
_GROUP = {"user_idx": "<i8", "x": "<f8", "home": "<i8", "row": "<i8", "score": "<f8",
          "item": "<i8", "words": "<i8", "bits": "<i8", "owner": "<i8"}


def _pack_users(held, k: int):
    """mapInArrow body: users (user_idx, features, home, scores, items, words, bits) as groups, and
    the blocks that any user of a group can want."""
    def pack(pdf: pd.DataFrame, number: int):
        boxes = held.value
        x = np.stack(pdf["features"].to_numpy()).astype("<f8")
        lists = _Lists(x, k, *_words(list(pdf["words"]), list(pdf["bits"])))
        sizes = [0 if s is None else len(s) for s in pdf["scores"]]
        row = np.repeat(np.arange(len(x)), sizes)
        score, item = (np.concatenate([np.asarray(v, kind) for v in pdf[c] if v is not None])
                       if len(row) else np.zeros(0, kind)
                       for c, kind in (("scores", "<f8"), ("items", "<i8")))
        if len(row):
            lists.merge(row, score, item)
        need = np.zeros(len(boxes.block), bool)
        table = pd.DataFrame({"user_idx": pdf["user_idx"], "features": list(x),
                              "kth": lists.score[:, -1], "item": lists.item[:, -1]})
        for _, _, may in _chances(table, boxes):
            need |= may.any(0)
        own = {"user_idx": pdf["user_idx"].to_numpy(), "x": x, "home": pdf["home"].to_numpy(),
               "row": row, "score": score, "item": item, "words": lists.words, "bits": lists.bits,
               "owner": lists.owner}
        return pa.RecordBatch.from_pydict({
            "number": pa.array([number], pa.int64()),
            "need": pa.array([boxes.block[need].tolist()], pa.list_(pa.int64())),
            **{c: pa.array([np.ascontiguousarray(own[c], kind).tobytes()], pa.binary())
               for c, kind in _GROUP.items()}})

    def run(batches):
        held_, users, words, number = [], 0, 0, 0
        for batch in batches:
            pdf = batch.to_pandas()
            count = np.array([0 if w is None else len(w) for w in pdf["words"]], np.int64)
            lo = 0
            while lo < len(pdf):
                # as many users as fill the group, one at least
                left = np.cumsum(count[lo:]) + words
                n = int(min(GROUP_USERS - users, np.searchsorted(left, GROUP_WORDS, "right")))
                n = max(n, 0 if held_ else 1)
                if n:
                    held_.append(pdf.iloc[lo:lo + n])
                    users, words, lo = users + min(n, len(pdf) - lo), int(
                        left[min(n, len(left)) - 1]), lo + n
                if lo < len(pdf):
                    yield pack(pd.concat(held_, ignore_index=True), number)
                    held_, users, words, number = [], 0, 0, number + 1
        if held_:
            yield pack(pd.concat(held_, ignore_index=True), number)
    return run


def _score_stream(held, k: int, block_words: int):
    """mapInArrow body: pairs of a block of items and a group of users in any order; at the end
    the lists of the groups."""
    def run(batches):
        groups = {}
        for batch in batches:
            for r in range(batch.num_rows):
                def of(name, kind, at=r, batch=batch):
                    return np.frombuffer(batch.column(name)[at].as_buffer(), kind)

                number = batch.column("number")[r].as_py()
                if number not in groups:
                    own = {c: of(c, kind).copy() for c, kind in _GROUP.items()}
                    x = own["x"].reshape(len(own["user_idx"]), -1)
                    lists = _Lists(x, k, own["words"], own["bits"], own["owner"])
                    if len(own["row"]):
                        lists.merge(own["row"], own["score"], own["item"])
                    groups[number] = own["user_idx"], own["home"], lists
                _, home, lists = groups[number]
                block = batch.column("block")[r].as_py()
                boxes = held.value.only(block)
                bound, exact = boxes.bounds(lists.x)
                may = boxes.may(bound, exact, lists.score[:, -1:], lists.item[:, -1:])[:, 0]
                rows = np.flatnonzero(may & (home != block))
                if len(rows):
                    ids = of("ids", "<i8")
                    lists.meet(rows, ids, of("vectors", "<f8").reshape(len(ids), -1),
                               block * block_words)
        for users, _, lists in groups.values():
            row, place = lists.rows()
            yield pa.RecordBatch.from_pydict({
                "user_idx": pa.array(users[row]), "item_idx": pa.array(lists.item[row, place]),
                "score": pa.array(lists.score[row, place]),
                "rank": pa.array((place + 1).astype(np.int32))})
    return run


def score_streamed(users: DataFrame, best: DataFrame, placed: DataFrame, boxes: Boxes,
                   seen: DataFrame | None, k: int, block_items: int) -> DataFrame:
    """(user_idx, item_idx, score, rank): the lists of ``users`` (user_idx, features, home), whose
    ``best`` holds those of their block ``home``, over all blocks; a written table.

    Users are dealt into groups by that block. A task holds a group, reads all blocks of items from
    the written table one after the other, and keeps the lists: no item, user or candidate is
    shuffled by block, whatever the bounds exclude. A block that no user of a group can want is
    left out, and so is a user whom the bound of a block gives no chance."""
    sc = users.sparkSession.sparkContext
    held = sc.broadcast(boxes)
    lists = best.groupBy("user_idx").agg(F.collect_list(F.struct("score", "item_idx")).alias("_l"))
    rows = _with_seen(users.join(lists.select(
        "user_idx", F.col("_l.score").alias("scores"), F.col("_l.item_idx").alias("items")),
        "user_idx", "left"), seen)
    n = users.count()
    parts = max(1, -(-n // GROUP_USERS), min(4 * int(sc.defaultParallelism), -(-n // 256)))
    packed = ", ".join(f"{c} binary" for c in _GROUP)
    groups = (rows.select("user_idx", F.col("features").cast("array<double>").alias("features"),
                          "home", "scores", "items", "words", "bits")
              .repartitionByRange(parts, "home", "user_idx")
              .mapInArrow(_pack_users(held, k), f"number bigint, need array<bigint>, {packed}"))
    blocks = session.materialize(placed.groupBy("block").applyInArrow(
        lambda t: _pack_items(t.to_batches()), "block bigint, ids binary, vectors binary"),
        "packed-items", settings={"spark.sql.files.maxRecordsPerFile": str(FILE_BLOCKS)})
    pairs = blocks.coalesce(1).join(groups.hint("shuffle_replicate_nl"),
                                    F.array_contains("need", F.col("block")))
    out = session.materialize(pairs.mapInArrow(
        _score_stream(held, k, -(-block_items // 64)),
        "user_idx bigint, item_idx bigint, score double, rank int"), "streamed", True,
        {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)})
    session.discard(blocks)
    return out


def score_topk(users: DataFrame, item_factors: DataFrame, history: DataFrame | None,
               k: int = 5, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """R12 + W3/W4: the top-k items of every row of ``users`` (user_idx,
    features) by the product with ``item_factors`` (id, features), without the
    cells of ``history`` (user_idx, item_idx). Output: user_idx, item_idx,
    score, rank.

    Only the given users are scored. The items lie in blocks of near vectors
    (``split_tree``), each with a box around them; the box and the largest norm
    tell what a user can score in a block at most. A user meets the block of the
    largest bound first, in tiles of a block and about ``TILE_USERS`` users that
    want it: a user travels once, and a block as often as its users fill tiles.
    Then the k-th best score excludes blocks. If few are left (``NEAR`` a user),
    they are met in tiles, too; else groups of users meet the items as a stream
    (``score_streamed``), where nothing travels by block. To the driver come a
    sample for the splits and the boxes (at most about ``BOUNDS``; more items make
    larger blocks). A user's history travels as 64-bit words.

    Where the vectors give the bounds no hold (many columns, all directions and
    norms alike), every user meets every block: the products of exact lists are
    quadratic then, the disk is not.
    """
    users = materialize(users.select(F.col("user_idx").cast("bigint").alias("user_idx"),
                                     "features"), "users")
    items = item_factors.count()
    block_items = max(block_items, -(-2 * items // BOUNDS))
    placed = place_items(item_factors, block_items, split_tree(
        item_factors, -(-5 * items // (4 * block_items)) if items > block_items else 1, items))
    boxes = block_boxes(placed)
    if boxes is None:
        return _scored_tiles(users.withColumn("block", F.lit(0).cast("bigint")), placed, None, 1,
                             k).withColumn("rank", F.lit(0))
    seen = None
    if history is not None:
        word = f"block * {-(-block_items // 64)} + cast(place div 64 as bigint)"
        bits = (history.select(F.col("user_idx").cast("bigint").alias("user_idx"),
                               F.col("item_idx").cast("bigint").alias("item_idx"))
                .join(users.select("user_idx"), "user_idx", "left_semi")
                .join(placed.select("item_idx", F.expr(word).alias("word"), F.expr(
                    "shiftleft(1L, place % 64)").alias("bit")), "item_idx")
                .groupBy("user_idx", "word").agg(F.bit_or("bit").alias("bits")))
        lists = bits.groupBy("user_idx").agg(F.collect_list(F.struct("word", "bits")).alias("_l"))
        seen = session.materialize(lists.select(
            "user_idx", F.col("_l.word").alias("words"), F.col("_l.bits").alias("bits")),
            "seen-words", True)
    order = Window.partitionBy("user_idx").orderBy(F.col("score").desc(), F.col("item_idx"))

    def by_tiles(pairs: DataFrame, best: DataFrame | None) -> DataFrame:
        groups = pairs.groupBy("block").agg(F.expr(
            f"cast(ceil(count(1) / {TILE_USERS}) as bigint)").alias("groups"))
        found = _scored_tiles(pairs.join(users, "user_idx"), placed, seen, groups, k, block_items)
        if best is not None:
            found = found.unionByName(best.select("user_idx", "item_idx", "score"))
        return session.materialize(found.withColumn("rank", F.row_number().over(order).cast("int"))
                                   .where(F.col("rank") <= k), "best", True)

    best = by_tiles(materialize(next_blocks(users, None, boxes, k, 0, 1).distinct(),
                                "next-blocks"), None)
    if len(boxes.block) == 1:
        return best
    left = materialize(wanted_blocks(users, best, boxes, k), "wanted-blocks")
    n, wanted = left.agg(F.count(F.lit(1)), F.sum("wanted")).first()
    if not n:
        return best
    if wanted <= NEAR * n:
        own = users.join(left.select("user_idx"), "user_idx", "left_semi")
        return by_tiles(materialize(next_blocks(own, best, boxes, k, 1, len(boxes.block)).distinct(),
                                    "next-blocks"), best)
    streamed = score_streamed(left.drop("wanted").join(users, "user_idx"),
                              best.join(left.select("user_idx"), "user_idx", "left_semi"),
                              placed, boxes, seen, k, block_items)
    return best.join(left.select("user_idx"), "user_idx", "left_anti").select(
        "user_idx", "item_idx", "score", "rank").unionByName(streamed)
