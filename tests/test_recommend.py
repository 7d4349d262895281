import itertools

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from basketry.operators import interactions as I, recommend as R


def _brute(users, hist, ranked, k):
    order = [i for _, i in sorted(ranked)]
    out = {}
    for u in users:
        seen = {i for (v, i) in hist if v == u}
        out[u] = [i for i in order if i not in seen][:k]
    return out


@settings(max_examples=8, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=30),
       st.integers(1, 4))
def test_unseen_by_rank_matches_brute_force(spark, hist, k):
    users = list(range(7))
    ranked = [(r + 1, i) for r, i in enumerate([3, 1, 4, 0, 5, 9, 2, 6, 8, 7])]
    req = spark.createDataFrame([(u,) for u in users], "customer_id int")
    h = spark.createDataFrame([(u, i, 1) for u, i in hist] or [(0, 0, 0)],
                              "customer_id int, item_id int, quantity bigint")
    rk = spark.createDataFrame(ranked, "rank bigint, item_id int")
    got = {}
    for r in R.recommend_unseen_by_rank(req, h, rk, k).orderBy("customer_id", "rank").collect():
        got.setdefault(r.customer_id, []).append(r.item_id)
    want = _brute(users, hist, ranked, k)
    assert {u: got.get(u, []) for u in users} == want


def test_precision_recall(spark):
    recs = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], "customer_id string, item_id string")
    actual = spark.createDataFrame([("u", "a"), ("u", "c"), ("w", "a")], "customer_id string, item_id string")
    got = {r.customer_id: (r.precision, r.recall) for r in R.precision_recall(recs, actual, 5).collect()}
    assert got == {"u": (0.2, 0.5), "w": (0.0, 0.0)}
    s = R.summarize(R.precision_recall(recs, actual, 5)).first()
    assert s.n_customers == 2 and s.mean_precision == 0.1


def test_summary_when_nobody_bought(spark):
    empty = spark.createDataFrame([], "customer_id string, precision double, recall double")
    s = R.summarize(empty).first()
    assert (s.mean_precision, s.mean_recall) == (0.0, 0.0)


def test_global_rank(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([5, 9, 5, 1, 9, 0])], "item_id int, popularity bigint")
    got = [(r.rank, r.item_id) for r in R.global_rank(df, [F.col("popularity").desc(), F.col("item_id")], "rank", 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 4), (3, 0), (4, 2), (5, 3), (6, 5)]


def test_unseen_by_rank_in_small_ranges(spark):
    """Ranges of two ranks give what one range does, for a user who bought nearly all."""
    users, items = [1, 2, 3], 40
    hist = [(1, i) for i in range(items) if i not in (7, 30, 39)] + [(2, 0), (2, 5)]
    h = spark.createDataFrame([(u, i, 1) for u, i in hist], "customer_id int, item_id int, quantity int")
    ranked = [(i + 1, i) for i in range(items)]
    rk = spark.createDataFrame(ranked, "rank bigint, item_id int")
    req = spark.createDataFrame([(u,) for u in users], "customer_id int")
    want = _brute(users, hist, ranked, 5)
    for span in (2, 7, 4096):
        got = {u: [] for u in users}
        out = R.recommend_unseen_by_rank(req, h, rk, 5, span)
        for r in out.orderBy("customer_id", "rank").collect():
            got[r.customer_id].append(r.item_id)
        assert got == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "LeftAnti" not in plan


def _factors(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                                 f"{name} bigint, features array<float>")


def test_block_scorer_matches_numpy(spark):
    rng = np.random.default_rng(0)
    U = rng.normal(size=(6, 3)).astype(np.float32)
    V = rng.normal(size=(9, 3)).astype(np.float32)
    V[4] = V[2]                                        # a tie goes to the lower item
    hist = [(0, 1), (0, 2), (3, 8)] + [(5, i) for i in range(7)]
    h = spark.createDataFrame(hist, "user_idx bigint, item_idx bigint")
    S = U.astype(np.float64) @ V.astype(np.float64).T
    M = S.copy()
    for u, i in hist:
        M[u, i] = -np.inf
    for block in (100, 4, 1):
        for past, want in ((h, M), (None, S)):
            out = R.score_topk(_factors(spark, U, "user_idx"), _factors(spark, V), past, 4, block)
            got = {}
            for r in out.orderBy("user_idx", "rank").collect():
                got.setdefault(r.user_idx, []).append(r.item_idx)
            assert got == {u: [i for i in np.argsort(-want[u], kind="stable")[:4]
                               if np.isfinite(want[u, i])] for u in range(6)}


def test_scorer_without_items(spark):
    users = _factors(spark, [[1.0]], "user_idx")
    assert R.score_topk(users, _factors(spark, [[1.0]]).limit(0), None, 3).count() == 0


def test_fold_in_solves_the_least_squares_of_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(1)
    V = rng.normal(size=(30, 4)).astype(np.float32)
    cells = [(u, i, float(rng.uniform(0, 1))) for u in (3, 8) for i in range(u, 25)]
    frame = spark.createDataFrame(cells, "user_idx bigint, item_idx bigint, value double")
    for rows in (4096, 3):
        monkeypatch.setattr(R, "FOLD_ROWS", rows)
        got = {r.user_idx: np.array(r.features)
               for r in R.fold_in(frame, _factors(spark, V), 4, 0.1, 2.0).collect()}
        for u in (3, 8):
            a, b, n = V.T.astype(float) @ V, np.zeros(4), 0
            for v, i, x in cells:
                if v == u:
                    a += 2.0 * x * np.outer(V[i], V[i])
                    b += (1 + 2.0 * x) * V[i]
                    n += 1
            assert np.allclose(got[u], np.linalg.solve(a + 0.1 * n * np.eye(4), b), atol=1e-4)


def test_ranks_after_the_head_are_found(spark, monkeypatch):
    """The first ranks come by broadcast, later ones by a join."""
    monkeypatch.setattr(R, "HEAD", 3)
    hist = [(1, i) for i in range(8)] + [(2, 1)]
    h = spark.createDataFrame([(u, i, 1) for u, i in hist], "customer_id int, item_id int, quantity int")
    ranked = [(i + 1, i) for i in range(12)]
    req = spark.createDataFrame([(1,), (2,), (3,)], "customer_id int")
    out = R.recommend_unseen_by_rank(
        req, h, spark.createDataFrame(ranked, "rank bigint, item_id int"), 3)
    got = {}
    for r in out.orderBy("customer_id", "rank").collect():
        got.setdefault(r.customer_id, []).append(r.item_id)
    assert got == _brute([1, 2, 3], hist, ranked, 3)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_chosen_by_direction(spark, monkeypatch):
    """Vectors of one length: their norms exclude no block, their boxes do."""
    asked, plain = [], R.materialize

    def kept(df, name="table"):
        out = plain(df, name)
        if name == "next-blocks":
            asked.append(out.count())
        return out

    monkeypatch.setattr(R, "materialize", kept)
    t = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    V = np.column_stack([np.cos(t), np.sin(t)])[np.random.default_rng(4).permutation(300)]
    U = np.random.default_rng(5).normal(size=(30, 2))
    out = R.score_topk(_factors(spark, U, "user_idx"), _factors(spark, V), None, 3, 15)
    got = {}
    for r in out.orderBy("user_idx", "rank").collect():
        got.setdefault(r.user_idx, []).append(r.item_idx)
    S = U.astype(np.float32).astype(float) @ V.astype(np.float32).astype(float).T
    assert got == {u: list(np.argsort(-S[u], kind="stable")[:3]) for u in range(30)}
    assert sum(asked) < 30 * 20 / 3


def test_nothing_travels_by_block_where_bounds_exclude_nothing(spark, monkeypatch):
    """Vectors of all directions: every user wants every block. The pairs that are sent by block
    are one a user; lists are right with groups of few users and words, heavy histories, users
    without history, and ties, which go to the lower item."""
    from basketry import session
    asked = []

    def kept(df, name="table", *a):
        out = session.materialize(df, name, *a)
        if name == "next-blocks":
            asked.append(out.count())
        return out

    monkeypatch.setattr(R, "materialize", kept)
    rng = np.random.default_rng(6)
    U, V = rng.integers(-3, 4, size=(90, 12)), rng.integers(-3, 4, size=(400, 12))
    V[200:240] = V[:40]
    hist = [(u, i) for u in range(0, 90, 2) for i in rng.choice(400, 30, replace=False)]
    hist += [(7, i) for i in range(400) if i % 100] + [(9, i) for i in range(400)]
    h = spark.createDataFrame([(int(u), int(i)) for u, i in hist], "user_idx bigint, item_idx bigint")
    S = (U @ V.T).astype(float)
    for u, i in hist:
        S[u, i] = -np.inf
    want = {u: [i for i in np.argsort(-S[u], kind="stable")[:5] if np.isfinite(S[u, i])]
            for u in range(90)}
    for users, words in ((4096, 1 << 20), (7, 12)):
        monkeypatch.setattr(R, "GROUP_USERS", users)
        monkeypatch.setattr(R, "GROUP_WORDS", words)
        asked.clear()
        got, score = {}, {}
        for r in R.score_topk(_factors(spark, U, "user_idx"), _factors(spark, V), h, 5,
                              20).orderBy("user_idx", "rank").collect():
            got.setdefault(r.user_idx, []).append(r.item_idx)
            assert r.score == S[r.user_idx, r.item_idx] and r["rank"] == len(got[r.user_idx])
        assert got == {u: x for u, x in want.items() if x}
        assert asked == [90]
