"""Hot keys are dealt over partitions without changing a result; fits have planted answers."""
import math
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import factors as fx
from tessera.operators import regress
from tessera.operators.skew import hot_keys, salted_join
from tessera.operators.textstats import tfidf


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def skewed(spark, n=20000):
    """90 % of the rows hold key 0, some none."""
    key = F.when(F.col("id") % 10 < 9, F.lit(0)).when(F.col("id") % 100 == 99, F.lit(None)).otherwise(F.col("id"))
    return spark.range(n).select(key.cast("long").alias("k"), "id")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, no_broadcast, how):
    df = skewed(spark)
    per = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 4 <> 1")
    got = salted_join(df, per, ["k"], hot_keys(per, ["k"], "n", df.count()), ["id"], how)
    want = df.join(per, "k", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_hot_key_lands_in_many_partitions(spark, no_broadcast):
    df = skewed(spark)
    per = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(per, ["k"], "n", df.count())
    assert [r.k for r in hot.collect()] == [0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the maximum of n keeps the join in the plan
        sizes, plain = ([r.c for r in j.groupBy(F.spark_partition_id().alias("p"))
                         .agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).collect()]
                        for j in (salted_join(df, per, ["k"], hot, ["id"], "left"), df.join(per, "k", "left")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(plain) > 17000 and max(sizes) < 8000 and sum(sizes) == sum(plain) == 20000


def test_tfidf_with_a_term_in_every_text(spark, no_broadcast):
    docs = [(i, ["the"] * (1 + i % 3) + [f"w{i % 7}"]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<string>")
    seen = Counter(t for _, toks in docs for t in set(toks))
    want = {(i, t): (n, seen[t], n * math.log(61 / (seen[t] + 1))) for i, toks in docs for t, n in Counter(toks).items()}
    got = {(r.doc_id, r.term): (r.tf, r.df, r.tfidf) for r in tfidf(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)


def planted(spark, seed=4):
    """Ratings from offsets plus a rank-2 product, and held-out cells of the same matrix."""
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(80, 2)), rng.normal(size=(50, 2))
    m = 3 + 0.3 * rng.normal(size=(80, 1)) + 0.3 * rng.normal(size=(1, 50)) + 0.6 * u @ v.T
    cells = [(i, j, float(m[i, j])) for i in range(80) for j in range(50)]
    test = rng.random(len(cells)) < 0.2
    schema = "user_id bigint, item_id bigint, rating double"
    return (spark.createDataFrame([c for c, t in zip(cells, test) if not t], schema),
            spark.createDataFrame([c for c, t in zip(cells, test) if t], schema))


def rmse(df, col):
    return df.select(F.sqrt(F.avg((F.col("rating") - F.col(col)) ** 2))).first()[0]


def test_factors_find_a_planted_low_rank_matrix(spark):
    train, test = planted(spark)
    base = fx.fit_baseline(train)
    plain = rmse(base.transform(test, -99, 99), "prediction")
    model = fx.fit_factors(train, rank=4, reg=0.02, iters=8)
    assert rmse(model.transform(test, -99, 99), "prediction") < 0.4 * plain
    base.release()


def test_factors_repeat_with_the_same_seed(spark):
    train, test = planted(spark)
    train = train.coalesce(1)
    got = [rows(fx.fit_factors(train, rank=2, iters=2, seed=7, blocks=2).transform(test), "user_id", "item_id", "prediction") for _ in range(2)]
    assert np.allclose(np.array(got[0]), np.array(got[1]), atol=1e-4)


def test_baseline_with_a_hot_item(spark, no_broadcast):
    data = [(u, 0, 1 + u % 5) for u in range(200)] + [(u, 1 + u % 9, 3) for u in range(0, 200, 10)]
    df = spark.createDataFrame(data, "user_id bigint, item_id bigint, rating int")
    model = fx.fit_baseline(df)
    mu = sum(r for *_, r in data) / len(data)
    b_i = sum(r - mu for _, i, r in data if i == 0) / (10 + 200)
    got = {r.item_id: (r.b_i, r.n_i) for r in model.b_item.collect()}
    assert got[0][0] == pytest.approx(b_i) and got[0][1] == 200
    pred = model.transform(df)
    assert pred.count() == len(data) and pred.filter("prediction is null").isEmpty()
    model.release()


def test_forest_repeats_with_the_same_seed(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("user_id"), (F.col("id") % 33).alias("item_id"),
                                 (1 + (F.col("id") % 20) / 5).cast("int").alias("rating")).coalesce(1)
    preds = [rows(regress.fit_forest(df, ["user_id", "item_id"]).transform(df), "user_id", "item_id", "prediction") for _ in range(2)]
    assert preds[0] == preds[1]
