"""Sets of numbers as 64-bit words."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.functions import bits as B
from basketry.operators import features as feat


def _longest(days):
    best = n = 0
    last = None
    for x in sorted(days):
        n = n + 1 if last is not None and x == last + 1 else 1
        best, last = max(best, n), x
    return best


def test_runs_of_a_word(spark):
    rng = random.Random(1)
    words = [0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) - 1, (1 << 64) - 2, 0b1011, 3 << 62]
    words += [rng.getrandbits(64) | rng.getrandbits(64) for _ in range(40)]
    words += [((1 << rng.randint(1, 64)) - 1 << rng.randint(0, 40)) & ((1 << 64) - 1)
              for _ in range(40)]
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    runs = B.starts_of_runs(F.col("w"))
    got = {r["w"]: (r["a"], r["b"], r["c"]) for r in spark.createDataFrame(
        [(w,) for w in signed], "w bigint").select("w", runs.alias("r")).select(
        "w", B.first_run(F.col("r")).alias("a"), B.last_run(F.col("r")).alias("b"),
        B.longest_run(F.col("r")).alias("c")).collect()}
    for w, s in zip(words, signed):
        text = f"{w:064b}"                       # the highest bit first
        want = (len(text) - len(text.rstrip("1")), len(text) - len(text.lstrip("1")),
                max(map(len, text.split("0"))))
        assert got[s] == want


@pytest.mark.parametrize("lo, hi", [(0, 200), (-150, 100), (60, 70), (-3000, 3000)])
def test_longest_runs(spark, lo, hi):
    rng = random.Random(hi)
    sets = {k: {rng.randint(lo, hi) for _ in range(rng.choice([1, 5, 80, 400]))} for k in range(30)}
    sets[100] = set(range(lo, hi + 1))                        # a run across many words
    sets[101] = set(range(lo, hi + 1)) - {(lo + hi) // 2}
    sets[102] = set(range(0, 64)) | set(range(128, 192))      # full words that do not touch
    rows = [(k, n) for k, own in sets.items() for n in own for _ in range(rng.randint(1, 2))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows + [(200, None)], "k int, n int").repartition(5)
    held = B.words(frame, ["k"], F.col("n"))
    assert {r["k"]: r["best"] for r in B.longest_runs(held, ["k"], "best").collect()} == {
        k: _longest(own) for k, own in sets.items()}
    assert {r["k"]: r["n"] for r in B.sizes(held, ["k"]).collect()} == {
        k: len(own) for k, own in sets.items()}


def test_sets_merge_and_meet(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(300)) for _ in range(500)]
    other = [(rng.randrange(8), rng.randrange(300)) for _ in range(400)]
    frame = lambda x: spark.createDataFrame(x, "k int, n int")
    a, b = (B.words(frame(x), ["k"], F.col("n")) for x in (rows, other))
    parts = [B.words(frame(rows[i::3]), ["k"], F.col("n")) for i in range(3)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[1])
    assert sorted(map(tuple, B.merge(union, ["k"]).collect())) == sorted(map(tuple, a.collect()))
    mine, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for k, n in rows:
        mine[k].add(n)
    for k, n in other:
        theirs[k].add(n)
    want = {k: len(mine[k] & theirs[k]) for k in mine if mine[k] & theirs[k]}
    assert {r["k"]: r["n"] for r in B.common(a, b, ["k"]).collect()} == want


def test_streaks_use_no_window(spark):
    days = [("a", f"2023-0{m}-{d:02d}") for m in (1, 2, 3, 4, 5, 6, 7) for d in range(1, 29)]
    days += [("a", d) for d in ("2023-01-29", "2023-01-30", "2023-01-31")] + [("b", None)]
    days += [("c", str(x)[:10]) for x in pd.date_range("2022-10-05", "2023-06-01")]
    p = spark.createDataFrame(days, "customer_id string, d string").select(
        "customer_id", F.col("d").cast("date").alias("purchase_date"))
    out = feat.longest_streaks(p, "2023-01-01")
    # January, February and the first 28 days of March without a gap; October to June
    assert {r.customer_id: r.longest_purchase_streak for r in out.collect()} == {"a": 87, "c": 240}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan
