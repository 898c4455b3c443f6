"""Findings of round 3: the same rows with work that stays bounded a task and moves once."""

import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import clean, similarity
from tessera.operators.factors import cv_copies, fit_baseline
from tessera.operators.neighbors import lsh_similarity_join
from tessera.operators.textstats import doc_tokens, tfidf, word_degrees
from tessera.plans import catalog
from tessera.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def orders(spark, tmp_path):
    """Orders of a few customers, with lines of unknown, repeated and null keys."""
    spark.range(400).select(F.when(F.col("id") % 97 == 5, None).otherwise(F.col("id")).alias("o_orderkey"),
                            F.when(F.col("id") % 41 == 3, None).otherwise(F.col("id") % 37).alias("o_custkey")) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3000).select((F.col("id") % 430).alias("l_orderkey"), F.when(F.col("id") % 89 == 1, None).otherwise(F.col("id") * 7 % 53).alias("l_partkey"),
                             F.when(F.col("id") % 13 == 1, None).otherwise((F.col("id") * 11 % 50 + 1).cast("double")).alias("l_quantity")) \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_ratings_tasks_grow_with_the_lines(spark, orders, monkeypatch):
    want = rows(tables.ratings_from_orders(spark, orders))
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    many = tables.ratings_from_orders(spark, orders)
    assert len(want) > 300 and rows(many) == want
    assert many.rdd.getNumPartitions() == 31


def test_lsh_join_is_sparks_join_without_all_bucket_pairs(spark):
    pts = spark.range(900).select("id", F.array((F.col("id") % 30).cast("double"), F.floor(F.col("id") / 30) * 0.9).alias("v"))
    a, b = pts.filter("id % 3 <> 0"), pts.filter("id % 3 = 0")
    for tables_, length in ((1, 2.0), (3, 1.0), (4, 5.0)):
        got = lsh_similarity_join(a, b, 1.5, "v", length, tables_, 7, ["id", "v"], ["id"])
        va, vb = (x.withColumn("v", array_to_vector("v")) for x in (a, b))
        model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=length, numHashTables=tables_, seed=7).fit(va)
        want = model.approxSimilarityJoin(va, vb, 1.5, "dist").select("datasetA.id", "datasetA.v", "datasetB.id", "dist")
        assert got.columns == ["a_id", "a_v", "b_id", "dist"]
        assert sorted((x[0], x[1], x[2], round(x[3], 9)) for x in got.collect()) == sorted((x[0], x[1], x[2], round(x[3], 9)) for x in want.collect())
        assert "Aggregate" not in plan(got)


def test_held_out_baselines_are_those_of_copies(spark):
    data = [(u, i, None if (u + i) % 17 == 0 else (u * 5 + i * 3) % 5 + 1, (u * 7 + i) % 4) for u in range(12) for i in range(9) if (u * i) % 4 != 1]
    data += [(50, 60, 5, 2), (50, 61, 4, 2), (None, 1, 3, 0), (2, None, 2, 1), (3, 3, 1, 0), (3, 3, 1, 0)]
    folded = spark.createDataFrame(data, "user_id long, item_id long, rating int, fold long")
    train, test = cv_copies(folded, "fold", 4)
    want = fit_baseline(train, by=["cv_fold"]).transform(test)
    got = fit_baseline(folded, by=["cv_fold"], held_out=("fold", 4)).transform(test)

    def plain(df):
        return sorted(((x.user_id, x.item_id, x.rating, x.cv_fold, round(x.prediction, 9)) for x in df.collect()), key=str)
    assert plain(got) == plain(want) and len(plain(got)) == len(data)


def test_column_similarities_of_heavy_rows_in_parts(spark, monkeypatch):
    cells = [(r, c, (r * c) % 5 + 1) for r in range(8) for c in range(40) if (r + c) % 3 or r == 0] + [(9, 1, 2), (9, 1, 3), (None, 2, 1)]
    ratings = spark.createDataFrame(cells, "user_id long, item_id long, rating int")
    norm, want = {}, {}
    known = [x for x in cells if x[0] is not None]
    for _, c, x in known:
        norm[c] = norm.get(c, 0) + x * x
    for r, c, x in known:
        for s, d, y in known:
            if r == s and c < d:
                want[c, d] = want.get((c, d), 0) + x * y / (norm[c] * norm[d]) ** 0.5
    for size in (1000, 7):
        monkeypatch.setattr(similarity, "PART", size)
        got = {(x.a, x.b): x.cosine for x in similarity.column_similarities(ratings, 0.1).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
def test_repair_reads_persisted_sides(spark, orders):
    for side in catalog.item_split(spark, orders):
        assert "InMemoryRelation" in plan(side)
    train = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 1)], "user_id long, item_id long")
    pairs = spark.createDataFrame([(1, 9), (2, 9), (2, 8), (1, 2), (None, 7)], "user_id long, item_id long")
    got = rows(clean.repair_unknown(pairs.withColumn("old", F.col("item_id")), train).select("user_id", "old", "item_id"))
    new = {old: item for _, old, item in got}
    assert len(got) == 5 and new[9] in (1, 2) and new[8] in (1, 3) and new[7] == 7 and new[2] == 2


def test_word_degrees_of_odd_breaks(spark):
    docs = spark.createDataFrame([(1, "the, . red fox --  jumps, the"), (2, ""), (3, None), (4, "!! the of"), (5, " fox   red\n\nfox"), (1, "fox")],
                                 "doc_id long, text string")
    degrees = word_degrees(docs)
    # the phrases are cut at one character, not by a pattern, and no lambda goes over them
    assert "\\s*" not in plan(degrees)
    assert degrees.filter("doc_id = 5").count() == 2


def test_tfidf_leaves_breakers_out_after_the_explode(spark):
    docs = spark.createDataFrame([(1, "the fox, the red fox"), (2, "the of."), (3, None), (4, "red -- red")], "doc_id long, text string")
    want, got = rows(tfidf(doc_tokens(docs, clean=True))), rows(tfidf(doc_tokens(docs), clean=True))
    assert got == want and got
