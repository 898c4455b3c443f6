"""The implicit centred matrix, SVD and covariance components against numpy; gradient descent and stacked ALS on planted data."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import factors, implicit, sgd

BIG = 1 << 40      # ids beyond 32 bits


def triples(spark, dense, base=BIG):
    rows = [(int(u) + base, int(i) * 3 + base, float(dense[i, u])) for i, u in zip(*np.nonzero(dense))]
    return spark.createDataFrame(rows + [(None, 1, 2.0), (1, None, 2.0), (base, base, None)], "user_id long, item_id long, rating double")


def sparse(rows, cols, seed=0, share=0.3):
    rng = np.random.default_rng(seed)
    x = (rng.random((rows, cols)) < share) * rng.integers(1, 6, (rows, cols)).astype(float)
    x[:, 0], x[0] = 1, np.where(np.arange(cols) % 2, 2, 0)
    x[0, 0] = 1
    return x


@pytest.fixture(params=[4096, 16])
def blocks(request, monkeypatch):
    monkeypatch.setattr(implicit, "BLOCK", request.param)
    monkeypatch.setattr(implicit, "PIECE", 4 * request.param)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(implicit, "BLOCK", 16)
    monkeypatch.setattr(implicit, "PIECE", 64)


def local_matrix(d):
    return {r["b"]: np.frombuffer(r["data"]).reshape(-1, d.p) for r in d.blocks.collect()}


def whole(d):
    found = local_matrix(d)
    return np.concatenate([found[b] for b in sorted(found)])


def test_products_entries_inner_products(spark, blocks):
    x = sparse(40, 70)
    c = x - x.mean(axis=1, keepdims=True)
    m = implicit.centred_matrix(triples(spark, x)).scaled(0.5)
    assert (m.n_rows, m.n_cols) == x.shape
    q = m.random(3)
    z = m.transpose_times(q)
    assert np.allclose(whole(z), 0.5 * c.T @ whole(q)) and np.allclose(whole(m.times(z)), 0.25 * c @ c.T @ whole(q))
    pairs = spark.createDataFrame([(BIG + 3 * i, BIG + u) for i in (0, 5, 39) for u in (0, 1, 69)] + [(1, BIG), (BIG, 1), (None, None)],
                                  "item_id long, user_id long")
    got = {(r.item_id, r.user_id): r.value for r in m.entry(pairs, "item_id", "user_id").collect()}
    assert len(got) == 12 and all(v is None for (i, u), v in got.items() if i in (1, None) or u == 1)
    assert all(np.isclose(got[BIG + 3 * i, BIG + u], 0.5 * c[i, u]) for i in (0, 5, 39) for u in (0, 1, 69))
    both = spark.createDataFrame([(BIG + 3 * a, BIG + 3 * b) for a in (0, 7) for b in (0, 7, 12)] + [(BIG, 2)], "a long, b long")
    found = {(r.a, r.b): r["product"] for r in m.inner_products(both, "a", "b").collect()}
    assert found[BIG, 2] is None
    assert all(np.isclose(found[BIG + 3 * a, BIG + 3 * b], 0.25 * c[a] @ c[b]) for a in (0, 7) for b in (0, 7, 12))


def up_to_sign(got, want):
    return np.allclose(np.abs(got), np.abs(want), atol=1e-5) and all(min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-5 for g, w in zip(got.T, want.T))


def spread(rows, cols, seed=1):
    """Sparse cells with well separated leading components."""
    rng = np.random.default_rng(seed)
    x = np.zeros((rows, cols))
    for r, (a, b) in enumerate([(40, 14), (25, 8), (15, 5), (9, 3)]):
        x[rng.choice(rows, a, False)[:, None], rng.choice(cols, 30, False)] += b
    x[:, 0] += 1
    x[0] += 1
    return x


def test_svd_equals_numpy(spark, small_blocks):
    x = spread(60, 80)
    c = (x - x.mean(axis=1, keepdims=True)).T / np.sqrt(59)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    res = factors.item_factors_svd(triples(spark, x), k=3, iters=25)
    got = {r.item_id: r.vec for r in res.factors.collect()}
    assert np.allclose(res.singular_values, s[:3]) and np.allclose(res.eigenvalues, s[:3] ** 2 * 59 / 80)
    assert up_to_sign(np.array([got[BIG + 3 * i] for i in range(60)]), vt[:3].T)
    two = factors.first_components(res.factors, 2).collect()
    assert all(len(r.vec) == 2 and r.vec == got[r.item_id][:2] for r in two)


def test_covariance_pca_equals_numpy(spark, small_blocks):
    x = spread(60, 80)
    cov = np.cov(x - x.mean(axis=1, keepdims=True), bias=True)
    u, s, vt = np.linalg.svd(cov - cov.mean(axis=0), full_matrices=False)
    found, values = implicit.covariance_pca(implicit.centred_matrix(triples(spark, x)), k=3, iters=15)
    got = {r.item_id: r.factors for r in found.collect()}
    assert np.allclose(values, s[:3])
    assert up_to_sign(np.array([got[BIG + 3 * i] for i in range(60)]) / s[:3], u[:, :3])


def planted(spark, seed=3, users=150, items=120, rank=3):
    rng = np.random.default_rng(seed)
    x = np.clip(3 + (rng.normal(size=(users, rank)) @ rng.normal(size=(rank, items))) * 0.7, 1, 5)
    known = rng.random((users, items))
    rows = [(int(u) + BIG, int(i) + BIG, float(x[u, i]), bool(known[u, i] < 0.06)) for u, i in zip(*np.nonzero(known < 0.5))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double, test boolean").cache()
    return df.filter("not test").drop("test"), df.filter("test").drop("test")


def rmse(model, test):
    e = F.col("prediction") - F.col("rating")
    return model.transform(test).agg(F.sqrt(F.avg(e * e))).first()[0]


def test_sgd_on_planted_ratings(spark):
    train, test = planted(spark)
    als = rmse(factors.fit_factors(train, rank=3, reg=0.05, iters=10), test)
    model = sgd.fit_sgd(train, rank=3, epochs=5, rate=0.03, reg=0.01, blocks=2, passes=30)
    mine, bias = rmse(model, test), rmse(factors.fit_baseline(train), test)
    assert mine <= als and mine < 0.4 * bias
    again = [sgd.fit_sgd(t, rank=3, epochs=1, blocks=2).users.orderBy("user_id").limit(5).collect() for t in (train, train.repartition(5))]
    assert all(a.user_id == b.user_id and np.allclose(a.vec, b.vec) for a, b in zip(*again))     # but for the last digits of the mean
    odd = spark.createDataFrame([(None, BIG), (BIG, None), (7, 8)], "user_id long, item_id long")
    assert [r.prediction is not None for r in model.transform(odd).collect()] == [True] * 3
    assert sgd.fit_sgd(train.limit(0), rank=2, epochs=1).transform(odd).count() == 3


def test_stacked_cv_equals_single_fits(spark):
    train, _ = planted(spark, users=80, items=60)
    folded = train.withColumn("fold", F.pmod(F.xxhash64("user_id", "item_id"), F.lit(3)).cast("int"))
    got = {r.fold: r for r in factors.factors_cv(folded, "fold", 3, rank=3, reg=0.05, iters=15).collect()}
    for f in range(3):
        part = folded.filter(F.col("fold") == f)
        single = rmse(factors.fit_factors(folded.filter(F.col("fold") != f).drop("fold"), rank=3, reg=0.05, iters=15), part)
        assert got[f].n == part.count() and abs(got[f].rmse - single) < 0.05 * single


def test_products_broadcast_no_factor(spark, small_blocks, monkeypatch):
    """A block is one row of megabytes that Spark takes for a hundred bytes: no join may send factors through the driver."""
    plans, kept = [], implicit.kept

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)
    monkeypatch.setattr(implicit, "kept", seen)
    monkeypatch.setattr(implicit, "HELD", 512)      # several runs of blocks
    x = sparse(50, 90)
    c = x - x.mean(axis=1, keepdims=True)
    m = implicit.centred_matrix(triples(spark, x))
    q = m.random(4)
    z = m.transpose_times(q)
    assert np.allclose(whole(z), c.T @ whole(q)) and np.allclose(whole(m.times(z)), c @ c.T @ whole(q))
    plans.append(q.rows(m.row_index, "item_id")._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_sub_epoch_is_one_shuffle(spark, monkeypatch):
    """User and item blocks and the ratings they share meet by one exchange, each user block in a partition of its own."""
    plans, kept = [], sgd.kept

    def seen(df):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), df))
        return kept(df)
    monkeypatch.setattr(sgd, "kept", seen)
    ratings = spark.createDataFrame([(u, i, 1 + (u * i) % 5) for u in range(20) for i in range(15)], "user_id long, item_id long, rating int")
    model = sgd.fit_sgd(ratings, rank=3, epochs=1, blocks=3)
    subs = [p.split("Initial Plan")[0] for p, _ in plans[2:]]
    assert len(subs) == 3 and all(p.count("Exchange") == 1 and "Join" not in p for p in subs)
    assert model.transform(ratings).filter("prediction is not null").count() == 300


def test_factors_cv_joins_each_rating_once(spark, monkeypatch):
    """the models of all folds come from joins of N rows, where (k - 1) copies of each row were joined; nulls and an id of one fold included."""
    rng = np.random.default_rng(5)
    rows = [(u, i, int(rng.integers(1, 6)), int(rng.integers(0, 3))) for u in range(40) for i in range(25) if rng.random() < 0.6]
    rows += [(100, 3, 2, 1), (7, 200, 5, 0), (None, 3, 4, 2), (4, None, 1, 1)]
    folded = spark.createDataFrame(rows, "user_id long, item_id long, rating int, fold long").cache()
    train, test = factors.cv_copies(folded, "fold", 3)
    e = F.col("prediction") - F.col("rating")
    want = factors.fit_factors(train, 3, 0.05, 6, by=["cv_fold"]).transform(test).groupBy(F.col("cv_fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    want = sorted(want.collect())
    joined, salted = [], factors.salted_join

    def counted(rows, *a, **b):
        joined.append(rows.count())
        return salted(rows, *a, **b)
    monkeypatch.setattr(factors, "salted_join", counted)
    got = sorted(factors.factors_cv(folded, "fold", 3, rank=3, reg=0.05, iters=6).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-5)
    assert joined and max(joined) == len(rows)
