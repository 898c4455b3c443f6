import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import factors as fx
from tessera.operators import regress


def test_utility_last_wins(spark):
    ev = spark.createDataFrame([(1, 2, 3, 10), (1, 2, 5, 20), (1, 3, 4, 5)], "user_id bigint, item_id bigint, rating int, ts int")
    assert rows(fx.utility_triples(ev, ["ts"])) == [(1, 2, 5), (1, 3, 4)]


def test_dense_roundtrip(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, [1.0, 0.0, 3.0])], "k int, vec array<double>")
    t = fx.dense_to_triples(df, "k", "vec")
    assert rows(t) == [(1, 1, 2.0), (2, 0, 1.0), (2, 2, 3.0)]
    back = {r.k: r.vec for r in fx.triples_to_dense(t, "k", 3).collect()}
    assert back == {1: [0.0, 2.0, 0.0], 2: [1.0, 0.0, 3.0]}


def test_top_cosine_self_and_zero(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])],
                               "item_id bigint, vec array<double>")
    inc = [r.item_id for r in fx.top_cosine(df, "item_id", 0, 3).orderBy("rank").collect()]
    assert inc == [0, 1, 4]
    exc = [r.item_id for r in fx.top_cosine(df, "item_id", 0, 10, include_self=False).orderBy("rank").collect()]
    assert exc == [1, 4, 2]  # zero vector has no cosine and is dropped


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "k int, vec array<double>")
    comp = fx.fit_pca(df, 3)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    pc = np.array(comp.pc)
    for j in range(3):
        assert abs(abs(pc[:, j] @ vt[j]) - 1) < 1e-8      # same component up to sign
    scores = np.array([r.factors for r in fx.pca_scores(df, comp, "k").orderBy("k").collect()])
    assert np.allclose(np.abs(scores), np.abs(c @ vt[:3].T), atol=1e-8)


def test_covariance_population(spark):
    x = np.array([[1.0, 2.0], [2.0, 1.0], [4.0, 7.0]])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "k int, vec array<double>")
    cov = {(r.i, r.j): r.cov for r in fx.covariance(df).collect()}
    ref = np.cov(x.T, bias=True)
    for (i, j), v in cov.items():
        assert v == pytest.approx(ref[i, j])


def test_ridge_closed_form_equals_spark_ml(spark):
    rng = np.random.default_rng(3)
    data = [(int(u), int(i), int(r)) for u, i, r in zip(rng.integers(0, 50, 300), rng.integers(0, 80, 300),
                                                        rng.integers(1, 6, 300))]
    df = spark.createDataFrame(data, "user_id bigint, item_id bigint, rating int")
    ml = {r.term: r.value for r in regress.fit_ridge(df, ["user_id", "item_id"]).coefficients().collect()}
    cf = regress.ridge_closed_form(df, "user_id", "item_id").collect()[0]
    assert cf.b1 == pytest.approx(ml["user_id"], rel=1e-9, abs=1e-12)
    assert cf.b2 == pytest.approx(ml["item_id"], rel=1e-9, abs=1e-12)
    assert cf.b0 == pytest.approx(ml["intercept"], rel=1e-9)


def test_baseline_brute_force(spark):
    data = [(1, 1, 5), (1, 2, 3), (2, 1, 4), (3, 2, 1), (3, 3, 2)]
    df = spark.createDataFrame(data, "user_id bigint, item_id bigint, rating int")
    model = fx.fit_baseline(df, reg_item=1.0, reg_user=2.0)
    mu = sum(r for *_, r in data) / len(data)
    bi = {i: sum(r - mu for u, j, r in data if j == i) / (1 + sum(1 for u, j, r in data if j == i)) for i in (1, 2, 3)}
    bu = {u: sum(r - mu - bi[j] for v, j, r in data if v == u) / (2 + sum(1 for v, *_ in data if v == u))
          for u in (1, 2, 3)}
    pairs = spark.createDataFrame([(1, 3), (2, 2), (9, 9)], "user_id bigint, item_id bigint")
    got = {(r.user_id, r.item_id): r.baseline for r in model.transform(pairs).collect()}
    assert got[(1, 3)] == pytest.approx(mu + bu[1] + bi[3])
    assert got[(2, 2)] == pytest.approx(mu + bu[2] + bi[2])
    assert got[(9, 9)] == pytest.approx(mu)


def test_cv_copies_sizes(spark):
    df = spark.range(200).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("item_id"),
                                 F.lit(3).alias("rating"))
    from tessera.operators.splits import add_fold
    folded = add_fold(df, ["user_id", "item_id"], 5, "cv")
    train, test = fx.cv_copies(folded, "fold", 5)
    assert train.count() == 4 * 200 and test.count() == 200
    per = dict(rows(test.groupBy("cv_fold").count()))
    for f, n in per.items():
        assert train.filter(F.col("cv_fold") == f).count() == 200 - n


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(11)
    n_users, n_items = 60, 20
    low = rng.normal(size=(n_users, 3)) @ rng.normal(size=(3, n_items)) * 2
    dense = np.clip(np.rint(low + 3), 1, 5)
    mask = rng.random((n_users, n_items)) < 0.5
    trip = [(u, i, int(dense[u, i])) for u in range(n_users) for i in range(n_items) if mask[u, i]]
    df = spark.createDataFrame(trip, "user_id bigint, item_id bigint, rating int")
    users = sorted({u for u, _, _ in trip})
    items = sorted({i for _, i, _ in trip})
    m = np.zeros((len(users), len(items)))
    for u, i, v in trip:
        m[users.index(u), items.index(i)] = v
    c = m - m.mean(0)
    a = c / np.sqrt(len(items) - 1)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    res = fx.item_factors_svd(df, k=3, iters=30, oversample=5)
    assert np.allclose(res.singular_values, s[:3], rtol=1e-6)
    got = {r.item_id: r.vec for r in res.factors.collect()}
    v = np.array([got[i] for i in items])
    for j in range(3):
        assert abs(abs(v[:, j] @ vt[j]) - 1) < 1e-6


def test_stacked_models_have_blocks_of_their_own(spark):
    """ALS deals positions by remainder: no block of a stacked fit holds two groups, and no two ids share a position."""
    from tessera.operators import factors
    ids = [(g, u, i) for g in range(3) for u, i in zip(range(7), (3, 1, 0, 6, 2, 5, 4))]
    index = spark.createDataFrame([(x, x) for x in range(7)], "id long, at long")
    placed = factors.positions(spark.createDataFrame(ids, "g int, u long, i long"), index.toDF("u", "at"), index.toDF("i", "at"), "u", "i", ["g"], 2, 3).collect()
    for col in ("__u", "__i"):
        assert len({r[col] for r in placed}) == 21 and all(r[col] % 6 // 2 == r["g"] for r in placed)
