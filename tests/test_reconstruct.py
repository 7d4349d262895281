"""Linear reconstruction, its encoder, and the scorer with norm bounds."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import interactions as I
from basketry.operators import recommend as R
from basketry.operators import reconstruct as L
from basketry.plans import training
from basketry.settings import Settings
from basketry.sources import warehouse as wh

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def _cells(spark, x, parts=3):
    rows = [(int(u), int(i), float(x[u, i])) for u, i in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "user_idx bigint, item_idx bigint, value double").repartition(
        parts)


def _dense(frame, key, n, width):
    out = np.zeros((n, width))
    for r in frame.collect():
        out[r[key]] = r["features"]
    return out


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(50, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(30, 12)))
    x = u * (10.0 * 0.6 ** np.arange(12)) @ v.T
    x[:, 7] = 0                                   # an item nobody bought
    x[4] = 0                                      # a user without cells
    x[np.abs(x) < 0.02] = 0
    return x


def test_directions_agree_with_svd(spark, matrix):
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    errors = []
    for rank in (1, 3, 6):
        m = L.fit(_cells(spark, matrix), rank, iterations=40, tolerance=1e-13, extra=6)
        assert np.allclose(m.singular, s[:rank], rtol=1e-9)
        v = _dense(m.vectors, "item_idx", 30, rank)
        assert np.allclose(v.T @ v, np.eye(rank), atol=1e-9)
        assert np.allclose(matrix @ v @ v.T, matrix @ vt[:rank].T @ vt[:rank], atol=1e-6)
        e = L.error(_cells(spark, matrix), m.vectors, rank)
        assert e == pytest.approx((s[rank:] ** 2).sum(), rel=1e-6)
        errors.append(e)
    assert errors[0] > errors[1] > errors[2]


def test_fit_does_not_depend_on_partitions(spark, matrix):
    one = L.fit(_cells(spark, matrix, 1), 3, iterations=30, tolerance=1e-12, extra=4)
    many = L.fit(_cells(spark, matrix, 7), 3, iterations=30, tolerance=1e-12, extra=4)
    assert np.allclose(_dense(one.vectors, "item_idx", 30, 3),
                       _dense(many.vectors, "item_idx", 30, 3), atol=1e-6)


def test_rank_beyond_the_matrix(spark):
    x = np.outer([1.0, 2.0, 0.0, 1.0], [0.5, 0.0, 1.0])
    m = L.fit(_cells(spark, x), 5, extra=3)
    assert m.rank == 1 and m.singular[0] == pytest.approx(np.linalg.norm(x))
    v = _dense(m.vectors, "item_idx", 3, 1)
    assert np.allclose(x @ v @ v.T, x, atol=1e-9) and v[2, 0] > 0
    assert L.error(_cells(spark, x), m.vectors, 1) == pytest.approx(0, abs=1e-9)


def test_empty_matrix(spark):
    m = L.fit(spark.createDataFrame([], "user_idx bigint, item_idx bigint, value double"), 3)
    assert m.rank == 0 and m.vectors.count() == 0


def test_encoder_takes_any_scaled_vector(spark, matrix):
    m = L.fit(_cells(spark, matrix), 4, iterations=40, tolerance=1e-13, extra=6)
    v = _dense(m.vectors, "item_idx", 30, 4)
    new = np.zeros((3, 30))
    new[0, [1, 5]], new[1, 29], new[2, 7] = [0.25, 0.5], 1.0, 1.0   # the last: an unknown item
    got = _dense(L.encode(_cells(spark, new), m.vectors, 4), "user_idx", 3, 4)
    assert np.allclose(got, new @ v, atol=1e-9)
    cells = L.reconstruct(_cells(spark, new), L.encode(_cells(spark, new), m.vectors, 4), m.vectors)
    want = new @ v @ v.T
    for r in cells.collect():
        assert r["fitted"] == pytest.approx(want[r["user_idx"], r["item_idx"]], abs=1e-9)


@pytest.mark.parametrize("cells, numbers, stripe", [(1 << 22, 1 << 23, 16), (40, 64, 3), (20, 90, 16)])
def test_grid_sends_vectors_by_tile_and_leaves_no_tables(spark, matrix, monkeypatch, cells, numbers,
                                                         stripe):
    """Products in tiles, in stripes of columns, packed in several rows; what a fit wrote on its way
    is removed."""
    from basketry import session
    for name, value in (("TILE_CELLS", cells), ("TILE_NUMBERS", numbers), ("STRIPE", stripe)):
        monkeypatch.setattr(L, name, value)
    before = len(session._written.get(spark.sparkContext.applicationId, []))
    grid = L.layout(_cells(spark, matrix), 7)
    q = np.random.default_rng(0).normal(size=(30, 7))
    some = np.arange(30) != 11                           # an item without a vector
    given = spark.createDataFrame([(i, [float(v) for v in q[i]]) for i in range(30) if some[i]],
                                  "item_idx bigint, features array<double>")
    y = L.grid_product(grid, given, "user_idx", "item_idx", 7)
    assert np.allclose(_dense(y, "user_idx", 50, 7), matrix[:, some] @ q[some], atol=1e-12)
    z = L.grid_product(grid, y, "item_idx", "user_idx", 7)
    assert np.allclose(_dense(z, "item_idx", 30, 7), matrix.T @ matrix[:, some] @ q[some], atol=1e-9)
    session.discard(y, z)
    grid.discard()
    m = L.fit(_cells(spark, matrix), 3, iterations=2, extra=4)
    e = L.encode(_cells(spark, matrix), m.vectors, 3)
    assert e.count() == (np.abs(matrix).sum(1) > 0).sum()
    left = session._written[spark.sparkContext.applicationId]
    assert len(left) == before + 1 and "directions" in left[-1]


@needs_data
def test_scores_agree_with_svd_on_the_tables(spark):
    p, i, c = wh.purchases(spark, SF), wh.items(spark, SF), wh.customers(spark, SF)
    am = I.interactions(p)
    cells = (I.minmax_scale(am, I.item_ranges(am, i))
             .join(I.dense_index(am, "customer_id", "user_idx"), "customer_id")
             .join(I.dense_index(i, "item_id", "item_idx"), "item_id")
             .select("user_idx", "item_idx", "value")).cache()
    rows = cells.collect()
    x = np.zeros((max(r.user_idx for r in rows) + 1, max(r.item_idx for r in rows) + 1))
    for r in rows:
        x[r.user_idx, r.item_idx] = r.value
    rank = 4
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    m = L.fit(cells, rank, iterations=60, tolerance=1e-12, extra=76)
    v = _dense(m.vectors, "item_idx", x.shape[1], rank)
    assert np.allclose(m.singular, s[:rank], rtol=1e-9)
    assert np.abs(x @ v @ v.T - x @ vt[:rank].T @ vt[:rank]).max() < 1e-6


@needs_data
def test_linear_back_end_trains_saves_and_serves(spark, tmp_dir):
    p, i, c = wh.purchases(spark, SF), wh.items(spark, SF), wh.customers(spark, SF)
    t = training.train(p, i, c, Settings(embedding_dim=6), max_iter=4, backend="linear")
    base = os.path.join(tmp_dir, "models")
    training.save(t, base, "20240101_000000")
    back = training.load_latest(spark, base)
    assert isinstance(back.model, L.Linear) and back.model.singular == t.model.singular
    req = c.select("customer_id")
    recs = training.recommend(back, req, i, 5).cache()
    assert recs.groupBy("customer_id").count().where("count <> 5").count() == 0
    assert recs.select("customer_id").distinct().count() == c.count()
    bought = t.all_matrix.where("quantity > 0").select("customer_id", "item_id")
    assert recs.join(bought, ["customer_id", "item_id"]).count() == 0
    # the scores are the reconstruction in quantities, the best of the items not bought
    iix = {r.item_id: r.item_idx for r in t.item_index.collect()}
    v = _dense(t.model.vectors, "item_idx", len(iix), 6)
    ranges = {r.item_id: (r.data_min, r.scale) for r in t.ranges.collect()}
    rows = {}
    for r in t.active_matrix.collect():
        rows.setdefault(r.customer_id, {})[r.item_id] = r.quantity
    columns = sorted({k for own in rows.values() for k in own})
    got = {}
    for r in recs.where("score is not null").collect():
        got.setdefault(r.customer_id, {})[r.rank] = (r.item_id, r.score)
    assert set(got) == set(rows)
    for u in sorted(rows)[:20]:
        x = np.zeros(len(iix))
        for item, q in rows[u].items():
            lo, scale = ranges[item]
            x[iix[item]] = (q - lo) / scale
        fitted = x @ v @ v.T
        score = {k: fitted[iix[k]] * ranges[k][1] + ranges[k][0] for k in columns
                 if rows[u].get(k, 0) <= 0}
        best = sorted(score.values(), reverse=True)[:5]
        assert np.allclose([got[u][r][1] for r in range(1, 6)], best, atol=1e-9)
    emb = training.user_embeddings(back, req)
    assert emb.count() == len(rows) and len(emb.first().embedding) == 6
    with pytest.raises(ValueError):
        training.train(p, i, c, backend="other")


# ---------------------------------------------------------------- the scorer
def _factors(spark, m, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                                 f"{name} bigint, features array<double>")


def _want(U, V, hist, k):
    s = U @ V.T
    for u, i in hist:
        s[u, i] = -np.inf
    return {u: [i for i in np.argsort(-s[u], kind="stable")[:k] if np.isfinite(s[u, i])]
            for u in range(len(U))}


def _got(out):
    got = {}
    for r in out.orderBy("user_idx", "rank").collect():
        got.setdefault(r.user_idx, []).append(r.item_idx)
    return got


@pytest.mark.parametrize("block, tile", [(64, 4), (7, 1000), (1, 3), (1000, 1)])
def test_bounded_scorer_matches_brute_force(spark, monkeypatch, block, tile):
    """Whole numbers, so ties are exact; norms of all sizes, zero vectors, and
    a user who has bought nearly everything."""
    rng = np.random.default_rng(block)
    U = rng.integers(-3, 4, size=(23, 3)).astype(float)
    V = rng.integers(-4, 5, size=(150, 3)).astype(float) * rng.choice([1, 1, 5], size=(150, 1))
    U[3] = V[9] = 0
    hist = [(u, i) for u in range(23) for i in rng.choice(150, 20, replace=False)]
    hist += [(5, i) for i in range(150) if i not in (140, 141)]
    monkeypatch.setattr(R, "TILE_USERS", tile)
    h = spark.createDataFrame([(int(u), int(i)) for u, i in hist], "user_idx bigint, item_idx bigint")
    for past, own in ((h, hist), (None, [])):
        out = R.score_topk(_factors(spark, U, "user_idx"), _factors(spark, V), past, 5, block)
        assert _got(out) == {u: x for u, x in _want(U, V, own, 5).items() if x}


def test_blocks_without_a_chance_are_not_scored(spark):
    rng = np.random.default_rng(1)
    U = rng.normal(size=(40, 4))
    V = rng.normal(size=(400, 4)) * np.geomspace(10, 0.01, 400)[rng.permutation(400)][:, None]
    users, placed = _factors(spark, U, "user_idx"), R.place_items(_factors(spark, V), 20)
    bounds, stretch, blocks = R.block_bounds(placed)
    norms = np.linalg.norm(V, axis=1)
    assert blocks == 20 and stretch == 1 and np.allclose(bounds, np.sort(norms)[::-1][::20])
    first = R._scored_tiles(users.withColumn("block", F.lit(0).cast("bigint")), placed, None, 1, 3)
    need = R.needed_blocks(users, first, bounds, stretch, blocks, 3)
    assert 0 < need.count() < 40 * 19 / 2
    # wider stretches ask for no less
    wide, step, n = R.block_bounds(placed, 3)
    assert (len(wide), step, n) == (3, 7, 20)
    more = R.needed_blocks(users, first, wide, step, n, 3)
    assert need.join(more, ["user_idx", "block"], "left_anti").count() == 0
    out = R.score_topk(users, _factors(spark, V), None, 3, 20)
    assert _got(out) == _want(U, V, [], 3)


def test_scorer_keeps_vectors_on_spark(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    taken = []
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: taken.append(self))
    rng = np.random.default_rng(2)
    out = R.score_topk(_factors(spark, rng.normal(size=(9, 2)), "user_idx"),
                       _factors(spark, rng.normal(size=(50, 2))), None, 3, 8)
    assert out.count() == 27 and not taken


def test_fit_writes_two_tables_an_iteration_and_joins_stripes(spark, matrix, monkeypatch):
    """Packed matrices in several parts, stripes in jobs of their own; the directions are those
    of one part and one job, and orthonormal columns are not written."""
    from basketry import session
    plain, written = L.materialize, []
    monkeypatch.setattr(L, "materialize",
                        lambda df, name="table", *a: written.append(name) or plain(df, name, *a))
    want = L.fit(_cells(spark, matrix), 3, iterations=2, tolerance=0.0, extra=4)
    assert written.count("product") == 5 and len(written) == 10
    before = len(session._written[spark.sparkContext.applicationId])
    for name, value in (("PART_NUMBERS", 40), ("JOB_BYTES", 3000), ("STRIPE", 2), ("TILE_CELLS", 200)):
        monkeypatch.setattr(L, name, value)
    got = L.fit(_cells(spark, matrix), 3, iterations=2, tolerance=0.0, extra=4)
    assert "stripes" in written
    assert np.allclose(got.singular, want.singular, rtol=1e-12)
    assert np.allclose(_dense(got.vectors, "item_idx", 30, 3), _dense(want.vectors, "item_idx", 30, 3),
                       atol=1e-9)
    assert len(session._written[spark.sparkContext.applicationId]) == before + 1
