"""Rows and values that splits, readers, parsers and classifiers must not lose."""
import pytest

from tessera.functions.parse import parse_py_list
from tessera.operators import classify as nb
from tessera.operators import content, factors, splits
from tessera.sources import readers


def test_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (2, 2)], "user_id long, item_id long")
    train, test = splits.hash_split(df, ["user_id", "item_id"])
    assert train.count() + test.count() == 4
    assert splits.hash_sample(df, 1.0, ["user_id"]).count() == 4


def test_bad_field_raises_or_is_null(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1\t2\t3\t9\nx\t5\t4\t9\n")
    with pytest.raises(Exception, match="user_id is not a number"):
        readers.read_ratings(spark, str(tmp_path / "r.dat")).collect()
    lenient = readers.read_ratings(spark, str(tmp_path / "r.dat"), strict=False)
    assert sorted((r.user_id or 0, r.item_id, r.rating) for r in lenient.collect()) == [(0, 5, 4), (1, 2, 3)]


def test_zero_rows_come_back(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "k int, vec array<double>")
    back = factors.triples_to_dense(factors.dense_to_triples(df, "k", "vec"), "k", 2, keys=df)
    assert {r.k: list(r.vec) for r in back.collect()} == {1: [0.0, 0.0], 2: [1.0, 0.0]}


def test_constants_inside_quotes_stay(spark):
    text = """[{'id': None, 'name': 'All or None, ever'}, {'id': 2, 'name': "True, it's"}]"""
    row = spark.createDataFrame([(text,)], "t string").select(parse_py_list("t").alias("x")).first().x
    assert [(r.id, r.name) for r in row] == [(None, "All or None, ever"), (2, "True, it's")]


def test_query_without_shared_terms_fills_its_ranks(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c", 2)], "k int, term string, n int")
    got = content.cosine_to_queries(t, "k", spark.createDataFrame([(1,), (4,)], "k int"), n=2)
    assert sorted((r["query"], r["rank"], r["k"], round(r["score"], 6)) for r in got.collect()) == [
        (1, 1, 2, 1.0), (1, 2, 3, 0.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]


def test_string_labels_end_to_end(spark):
    docs = spark.createDataFrame([(1, "pos", ["good", "fun"]), (2, "pos", ["good"]), (3, "neg", ["bad"]), (4, "neg", ["bad", "fun"])],
                                 "doc_id bigint, label string, tokens array<string>")
    vocab = nb.vocabulary(docs, 3)
    present = nb.presence(docs, vocab, keep=["label"])
    model = nb.fit_nb(present, docs.select("doc_id", "label"), vocab)
    pred = {r.doc_id: r.prediction for r in nb.predict_nb(model, present, docs.select("doc_id")).collect()}
    assert pred == {1: "pos", 2: "pos", 3: "neg", 4: "neg"}
    top = nb.informative_features(model, 2).collect()
    assert {(r.word, r.label_max) for r in top if r.present} <= {("good", "pos"), ("bad", "neg")} and top


def test_covariance_of_a_constant_dimension_is_zero(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "vec array<double>")
    got = {(r.i, r.j): r.cov for r in factors.covariance(df).collect()}
    assert got[(0, 0)] == pytest.approx(1.0) and got[(0, 1)] == got[(1, 0)] == got[(1, 1)] == 0.0
