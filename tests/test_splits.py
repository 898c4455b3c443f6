from pyspark.sql import functions as F

from tessera.operators.splits import add_fold, hash_split, prefix_split
from tessera.sources.readers import with_row_id


def test_folds_partition_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("user_id"), (F.col("id") * 3).alias("item_id"))
    train, test = hash_split(df, ["user_id", "item_id"], (9,), 10)
    assert train.count() + test.count() == 1000
    assert train.join(test, ["user_id", "item_id"]).count() == 0
    sizes = [r["count"] for r in add_fold(df, ["user_id", "item_id"], 10).groupBy("fold").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10


def test_prefix_split_exact_n(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    out = prefix_split(df, "doc_id", 123, salt="s")
    assert out.filter("is_test").count() == 123


def test_row_id_dense(spark):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("v")).repartition(5)
    ids = with_row_id(df, ["v"]).orderBy("v").collect()
    assert [r.id for r in ids] == list(range(1, 301))


def test_cross_validate_baseline(spark):
    from tessera.operators import factors as fx
    from tessera.operators.splits import cross_validate
    df = spark.range(300).select((F.col("id") % 17).alias("user_id"), (F.col("id") % 23).alias("item_id"),
                                 ((F.col("id") % 5) + 1).cast("int").alias("rating")).dropDuplicates(["user_id", "item_id"])
    res = cross_validate(df, lambda tr, te: fx.fit_baseline(tr).transform(te), ["user_id", "item_id"], k=3)
    got = res.orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2]
    assert all(0 <= r.mae <= r.rmse <= 4 for r in got)


def test_random_split_and_sample(spark):
    from tessera.operators.splits import hash_sample, random_sample, random_split
    df = spark.range(2000).select(F.col("id").alias("user_id"), F.lit(1).alias("item_id"))
    a, b = random_split(df, [0.8, 0.2], seed=42)
    assert a.count() + b.count() == 2000 and a.join(b, "user_id").count() == 0
    assert 0 < random_sample(df, 0.1, seed=1).count() < 400
    s1 = {r.user_id for r in hash_sample(df, 0.3, ["user_id", "item_id"], "x").collect()}
    s2 = {r.user_id for r in hash_sample(df, 0.3, ["user_id", "item_id"], "x").collect()}
    assert s1 == s2 and 450 < len(s1) < 750
