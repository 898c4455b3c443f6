import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators import clean


def test_replace_values_literal_and_frame(spark):
    df = spark.createDataFrame([(819, 375), (218, 35), (218, 30), (1, 375), (2, 7)], "user_id bigint, item_id bigint")
    m = {375: 100, 35: 101, 30: 102}
    got = rows(clean.replace_values(df, "item_id", m))
    assert got == [(1, 100), (2, 7), (218, 101), (218, 102), (819, 100)]
    mf = spark.createDataFrame(list(m.items()), "old bigint, new bigint")
    assert rows(clean.replace_values(df, "item_id", mf)) == got


def test_repair_unknown(spark):
    ratings = spark.createDataFrame([(819, 1, 3), (819, 2, 4), (218, 3, 5), (218, 4, 1), (5, 9, 2)],
                                    "user_id bigint, item_id bigint, rating int")
    pairs = spark.createDataFrame([(819, 375), (218, 35), (218, 30), (5, 9), (7, 375), (99, 500)],
                                  "user_id bigint, item_id bigint")
    out = {(r.user_id, r.old): r.item_id for r in
           clean.repair_unknown(pairs.withColumn("old", F.col("item_id")), ratings).collect()}
    assert out[(819, 375)] in (1, 2)
    assert out[(7, 375)] == out[(819, 375)]          # replacement applies to every row with the item
    assert {out[(218, 35)], out[(218, 30)]} == {3, 4}  # two distinct picks of user 218
    assert out[(5, 9)] == 9 and out[(99, 500)] == 500  # known item kept; owner without items unchanged


def test_missing_keys(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2,), (4,)], "k int")
    assert rows(clean.missing_keys(a, b, "k")) == [(1,), (3,)]


def test_keep_first_with_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, None), ("b", 4, None), ("b", 5, 1.0),
                                ("c", 6, 2.0), ("c", 7, 2.0)], "title string, id int, profit double")
    kept = clean.keep_first(df, ["title"], [F.desc_nulls_last("profit"), F.asc("id")])
    assert rows(kept, "title", "id") == [("a", 2), ("b", 5), ("c", 6)]


def test_null_profile_and_info(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    prof = dict(rows(clean.null_profile(df)))
    assert prof == {"a": pytest.approx(33.33), "b": pytest.approx(66.67)}
    info = rows(clean.column_info(df), "column", "dtype", "non_null")
    assert info == [("a", "int", 2), ("b", "string", 1)]


def test_round_half_even(spark):
    from tessera.functions.columns import round_half_even
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (0.125,)], "x double")
    got = [r[0] for r in df.select(round_half_even("x", 0)).collect()]
    assert got == [0.0, 2.0, 2.0, -0.0, 0.0]


def test_split_valid_rows(spark):
    from tessera.sources.readers import split_valid_rows
    df = spark.createDataFrame([("1", "2"), ("x", "3"), ("4", None)], "a string, b string")
    good, bad = split_valid_rows(df, {"a": "int", "b": "int"})
    assert sorted(good.collect(), key=str) == sorted([(1, 2), (4, None)], key=str)
    assert rows(bad) == [("x", "3")]


def test_flag_malformed(spark):
    df = spark.createDataFrame([("[{'iso_3166_1': 'US', 'name': 'United States of America'}]",), ("nan",), ("[]",)],
                               "c string")
    got = [r.parsed_ok for r in clean.flag_malformed(df, "c").collect()]
    assert got == [True, False, True]


def test_small_helpers(spark):
    from tessera.operators.neighbors import assemble_features, order_by_distance
    df = spark.createDataFrame([(1, "2.5", None), (2, "x", "b")], "a int, b string, c string")
    assert clean.select_rename(df, {"b": "text", "a": "id"}).columns == ["text", "id"]
    assert [r.b for r in clean.coerce_numeric(df, "b").collect()] == [2.5, None]
    assert clean.drop_nulls(df).count() == 1 and clean.drop_nulls(df, ["a"]).count() == 2
    toks = spark.createDataFrame([(["b", "a", "b", "c", "a"],)], "t array<string>")
    assert toks.select(clean.distinct_tokens("t")).collect()[0][0] == ["b", "a", "c"]
    nb = spark.createDataFrame([(1, 1, 2, 2, 3, 1.0), (1, 1, 1, 1, 4, 1.0), (1, 1, 0, 0, 5, 0.5)],
                               "test_user long, test_item long, train_user long, train_item long, rating int, dist double")
    assert [r.rating for r in order_by_distance(nb).collect()] == [5, 4, 3]
    v = assemble_features(spark.createDataFrame([(1, 2)], "u int, i int"), ["u", "i"], drop_inputs=True)
    assert v.columns == ["features"] and list(v.collect()[0].features) == [1.0, 2.0]
