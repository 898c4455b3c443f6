import pytest

from tessera.operators import content
from tessera.functions.parse import parse_py_list, field_lower


def test_recommend_excludes_query_and_ties(spark):
    items = spark.createDataFrame([(1, "red fast car"), (2, "red fast car"), (3, "blue slow car"), (4, "green tree"),
                                   (5, "red car")], "k int, bag string")
    cv = content.count_vectors(items, "k")
    rec = [(r.k, r.rank) for r in content.recommend_similar(cv, "k", 1, 4).orderBy("rank").collect()]
    assert rec == [(2, 1), (5, 2), (3, 3), (4, 4)]  # identical bag first, zero-score item last
    score = {r.k: r.score for r in content.recommend_similar(cv, "k", 1, 4).collect()}
    assert score[5] == pytest.approx(2 / (3 ** 0.5 * 2 ** 0.5)) and score[4] == 0.0
    multi = content.cosine_to_queries(cv, "k", items.filter("k in (1, 4)"), 2)
    assert {(r.query, r.k) for r in multi.collect()} == {(1, 2), (1, 5), (4, 1), (4, 2)}  # zero scores fill the ranks
    jac = {r.k: r.jaccard for r in content.jaccard_to_query(cv, "k", 1).collect()}
    assert jac[2] == 1.0 and jac[3] == pytest.approx(1 / 5)


def test_parse_python_literal_lists(spark):
    df = spark.createDataFrame([("[{'id': 16, 'name': 'Animation'}, {'id': 35, 'name': 'Comedy'}]",),
                                ("[{'id': 1, 'name': \"Children's\"}]",), ("[]",), (None,), ("nan",),
                                ("[{'id': 2, 'name': None}]",), ("False",)], "g string")
    got = [r[0] for r in df.select(field_lower(parse_py_list("g"), "name")).collect()]
    assert got[0] == ["animation", "comedy"]
    assert got[1] == ["children's"]
    assert got[2] == []
    assert got[3] is None and got[4] is None and got[6] is None
    assert got[5] == [None]


def test_bag_of_words(spark):
    df = spark.createDataFrame([(1, ["Action", "Fantasy"], "EN", 2015, "The monkey king fights the monkey")],
                               "k int, genres array<string>, lang string, year int, overview string")
    bag = content.bag_of_words(df, "k", lists=["genres"], texts=["lang"], numbers=["year"],
                               keyword_text="overview").collect()[0].bag
    assert bag == "Action Fantasy EN 2015 monkey king fights"
