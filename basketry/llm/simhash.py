"""SimHash near-deduplication by a binary-trie self-join.

Fingerprint: A-Z lower-cased, words, ``shingle``-word shingles with repeats,
joined by single spaces; bit i is set when more than half of the shingles'
XXH64 values (seed 42, unsigned) have it.

The distinct fingerprints, sorted, are a binary trie. The self-join starts
with the pair (root, root) and goes down both sides together: a pair of nodes
carries the number of bits in which their prefixes differ and is dropped as
soon as that exceeds the error budget of its depth. Two tries are walked, one
over each order of the two 32-bit halves: of two fingerprints within ``k``
bits, either the high halves differ in at most k//2 bits or the low halves in
at most k - k//2 - 1, so the budget over a trie's first 32 levels is only
half as large, and the surviving pairs of nodes grow little faster than the
number of fingerprints. Every link is found by one of the two walks.

Scale: the top of the trie is walked as DataFrames (node pairs joined with
node sizes, four levels at a time) until a pair of subtrees holds at most
``LEAVES`` fingerprints a side, however the fingerprints are spread; each
such pair is then one bounded group whose walk goes on in numpy, breadth
first in bounded chunks. A group returns a spanning forest of its links (a
row for each fingerprint that is not a root), never all pairs, and skips
node pairs that already lie in one component. Components are then joined by
min-label steps over written tables. Copies share a fingerprint, so a hot
group of copies is one leaf.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; fewer words than ``shingle`` give one
shingle of the whole sequence; rows that repeat a doc_id are separate rows of
the result; a null doc_id is never the smallest (component_id is null only
when a whole component has null ids); an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow, ship, table

HALF = 32
STEP = 4
#: Fingerprints of a subtree that one group takes, at most.
LEAVES = 16384
#: Node pairs that a chunk of the walk holds, at most.
CHUNK = 400_000
#: Shingles whose bits are counted together, at most.
VOTES = 1 << 16


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash
    words = (text or b"").lower().split()        # ASCII letters, ASCII white space
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, VOTES):
        hi = min(n, lo + VOTES)
        cut = zip(starts[lo:hi].tolist(), (ends[lo + width - 1:hi + width - 1] - 1).tolist())
        h = np.fromiter((digest(joined[a:b], 42) for a, b in cut), np.uint64, hi - lo)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64,
                             b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string")),
                     run, f"doc_id {id_type}, fp bigint")


# ---------------------------------------------------------------- the walk in numpy
def _compress(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the components of the links (i, j); roots are smallest indices."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        root = _compress(root)


def budgets(k: int, first: int) -> list[int]:
    """Differing bits allowed at each depth: ``first`` over the first half."""
    return [first if d <= HALF else k for d in range(65)]


def walk(keys: np.ndarray, depth: int, a: tuple[int, int], b: tuple[int, int], k: int,
         first: int, chunk: int = CHUNK) -> np.ndarray:
    """Root index of every key after all links between the subtrees ``a`` and
    ``b`` (index ranges of the sorted unsigned ``keys`` at ``depth``; the same
    range for a self-join)."""
    n = len(keys)
    allowed = budgets(k, first)
    root = np.arange(n)
    zeros: dict[int, np.ndarray] = {}

    def split(d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if d not in zeros:
            bit = ((keys >> np.uint64(63 - d)) & np.uint64(1)) == 0
            zeros[d] = np.concatenate(([0], np.cumsum(bit)))
        z = zeros[d]
        return lo + (z[hi] - z[lo])

    one = lambda x: np.array([x], np.int64)
    start = int(np.bitwise_count((keys[a[0]] ^ keys[b[0]]) >> np.uint64(64 - depth))) if (
        depth and a[1] > a[0] and b[1] > b[0]) else 0
    stack = [(depth, one(a[0]), one(a[1]), one(b[0]), one(b[1]), np.array([start], np.int8))]
    while stack:
        d, l1, h1, l2, h2, diff = stack.pop()
        if len(l1) > chunk:
            for at in range(0, len(l1), chunk):
                s = slice(at, at + chunk)
                stack.append((d, l1[s], h1[s], l2[s], h2[s], diff[s]))
            continue
        alive = (h1 > l1) & (h2 > l2)
        leaf = alive & (h1 - l1 == 1) & (h2 - l2 == 1)
        if leaf.any():
            i, j = l1[leaf], l2[leaf]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= k)
            root = _unite(root, i[near], j[near])
        go = alive & ~leaf
        if d >= 64 or not go.any():
            continue
        l1, h1, l2, h2, diff = l1[go], h1[go], l2[go], h2[go], diff[go]
        if len(l1) > 4096:
            # both subtrees in one component already: nothing left to learn
            run = np.maximum.accumulate(np.concatenate(
                ([0], np.where(root[1:] != root[:-1], np.arange(1, n), 0))))
            joined = (root[l1] == root[l2]) & (run[h1 - 1] <= l1) & (run[h2 - 1] <= l2)
            if joined.any():
                go = ~joined
                l1, h1, l2, h2, diff = l1[go], h1[go], l2[go], h2[go], diff[go]
        m1, m2 = split(d, l1, h1), split(d, l2, h2)
        self_ = l1 == l2
        plus = diff + np.int8(1)
        kids = [(l1, m1, l2, m2, diff), (m1, h1, m2, h2, diff), (l1, m1, m2, h2, plus),
                (m1[~self_], h1[~self_], l2[~self_], m2[~self_], plus[~self_])]
        kids = [tuple(x[(c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= allowed[d + 1])] for x in c)
                for c in kids]
        parts = [np.concatenate(x) for x in zip(*kids)]
        if len(parts[0]):
            stack.append((d + 1, *parts))
    return root


def _forest(k: int, firsts: tuple[int, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        turn, depth = int(pdf["turn"].iloc[0]), int(pdf["depth"].iloc[0])
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        keys = np.sort(pdf["key"].to_numpy(np.int64).view(np.uint64))
        if depth:
            top = (keys >> np.uint64(64 - depth)).astype(np.int64) if depth < 64 else (
                keys.view(np.int64))
            sides = [(int(np.flatnonzero(top == p)[0]), int(np.flatnonzero(top == p)[-1]) + 1)
                     for p in (a, b)]
        else:
            sides = [(0, len(keys))] * 2
        root = walk(keys, depth, sides[0], sides[1], k, firsts[turn])
        own = np.flatnonzero(root != np.arange(len(keys)))
        fp = keys if turn == 0 else (keys << np.uint64(32)) | (keys >> np.uint64(32))
        fp = fp.view(np.int64)
        return pd.DataFrame({"u": np.maximum(fp[own], fp[root[own]]),
                             "v": np.minimum(fp[own], fp[root[own]])})
    return run


# ---------------------------------------------------------------- the walk on Spark
def _prefix(key, depth):
    """The top ``depth`` bits of a key, as a long (depth 0: 0)."""
    return F.when(F.lit(depth) == 0, F.lit(0).cast("bigint")).otherwise(
        F.shiftrightunsigned(key, 64 - depth if depth else 0))


def links(fps: DataFrame, k: int = 4, leaves: int = LEAVES) -> DataFrame:
    """(u, v) with u > v: links that connect exactly the fingerprints connected
    by pairs within ``k`` bits. ``fps``: a written table with distinct ``fp``."""
    firsts = tuple(x for x in (k // 2, k - k // 2 - 1) if x >= 0)
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    keys = fps.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("turn"), key.alias("key"))
        for t, key in enumerate((F.col("fp"), turned)[:len(firsts)])])).alias("x")).select("x.*")
    spark = fps.sparkSession
    n = fps.count()
    big = spark.createDataFrame([(t, 0, 0) for t in range(len(firsts))],
                                "turn int, a bigint, b bigint")
    small, depth = [], 0
    if n <= leaves:
        small.append((0, big))
    else:
        while True:
            depth += STEP
            size = table(keys.select("turn", _prefix(F.col("key"), depth).alias("node"))
                         .groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n")),
                         f"trie-nodes{depth}")
            kid = size.select("turn", F.col("node"), "n",
                              F.shiftrightunsigned("node", STEP).alias("up"))
            left = kid.select("turn", F.col("up").alias("a"), F.col("node").alias("a2"),
                              F.col("n").alias("na"))
            right = kid.select("turn", F.col("up").alias("b"), F.col("node").alias("b2"),
                               F.col("n").alias("nb"))
            diff = F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
            first = F.element_at(F.array(*[F.lit(f) for f in firsts]), F.col("turn") + 1)
            pairs = (big.join(left, ["turn", "a"]).join(right, ["turn", "b"])
                     .where((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2")))
                     .where(diff <= (first if depth <= HALF else F.lit(k)))
                     .select("turn", F.col("a2").alias("a"), F.col("b2").alias("b"), "na", "nb"))
            pairs = table(pairs, f"trie-pairs{depth}")
            fits = (F.col("na") <= leaves) & (F.col("nb") <= leaves)
            if depth >= 64:
                fits = F.lit(True)
            small.append((depth, pairs.where(fits).select("turn", "a", "b")))
            big = pairs.where(~fits).select("turn", "a", "b")
            if not big.take(1):
                break
    jobs = None
    for d, pairs in small:
        both = pairs.select("turn", F.lit(d).alias("depth"), "a", "b", F.explode(F.array_distinct(
            F.array("a", "b"))).alias("node"))
        own = keys.withColumn("node", _prefix(F.col("key"), d))
        part = both.join(own, ["turn", "node"]).select("turn", "depth", "a", "b", "key")
        jobs = part if jobs is None else jobs.unionByName(part)
    ship(spark)
    return jobs.groupBy("turn", "depth", "a", "b").applyInPandas(
        _forest(k, firsts), "u bigint, v bigint")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(u, root): the smallest node that each node u, other than a root, is
    connected with. ``edges``: (u, v) with u > v.

    Each round every node takes its smallest smaller neighbour and hangs the
    others below it, then parents are replaced by their parents, until all
    edges point to roots. The edges are keyed by the larger node, which has
    few; the join on a parent, where a large component meets, is between two
    plain scans and so can be split by Spark's skew handling.
    """
    e = table(edges.distinct(), "cc-edges")
    while True:
        least = table(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")),
                      "cc-least")
        other = (e.join(least.where("n > 1"), "u").where("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        flat = table(least.select("u", F.col("m").alias("v")).unionByName(other).distinct(),
                     "cc-flat")
        parent = table(flat.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("pp")),
                       "cc-parent")
        moved = table(flat.join(parent, flat["v"] == parent["p"], "left")
                      .select("u", F.coalesce("pp", "v").alias("v"),
                              F.col("pp").isNotNull().alias("moved")).distinct(), "cc-moved")
        rows, changed, nodes = moved.agg(
            F.count(F.lit(1)), F.count(F.when(F.col("moved"), 1)),
            F.countDistinct("u")).first()
        e = moved.select("u", "v").distinct()
        if not changed and rows == nodes:
            return e.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, k: int = 4, leaves: int = LEAVES,
                    marks: DataFrame | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest
    doc_id reachable by links of at most ``k`` differing bits. ``marks``: a
    table (doc_id, fp) to use instead of fingerprinting ``docs``."""
    if marks is None:
        marks = table(fingerprints(docs, shingle), "simhash-marks")
    fps = table(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    labels = table(components(links(fps, k, leaves)), "simhash-labels")
    # nodes that are roots of others carry their own label
    full = labels.unionByName(labels.select(F.col("root").alias("u"), "root").distinct())
    full = table(full.join(fps, full["u"] == fps["fp"]).select("fp", "root", "least"),
                 "simhash-members")
    smallest = table(full.groupBy("root").agg(F.min("least").alias("component_id")),
                     "simhash-smallest")
    of = table(full.select("fp", "root").join(smallest, "root").select("fp", "component_id"),
               "simhash-linked")
    ids = table(fps.join(of, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-ids")
    return marks.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> object:
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def survivors(docs: DataFrame, shingle: int = 4, k: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id of a component:
    one document of each group. The others' ids, commonly few, are taken out
    by an anti-join, so that Spark can spare the texts a shuffle where their
    table is small. An id that repeats stays if any of its rows does."""
    found = near_duplicates(docs, shingle, k)
    gone = (found.groupBy("doc_id").agg(
        F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
        .where(~F.col("stays")).select(F.col("doc_id").alias("gone")))
    gone = table(gone, "simhash-gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")
