"""Named queries over the driver's tables: one per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
columns match the DuckDB twin in :mod:`tessera.plans.oracle`. Doubles that
the oracle cannot reproduce bit for bit are rounded (``bround``) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.metrics import regression_metrics
from tessera.operators.neighbors import knn_predict, lattice_neighbors
from tessera.operators.splits import add_fold
from tessera.sources.tables import ratings_from_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


KEYS = ["user_id", "item_id"]


def rating_split(spark: SparkSession, d: str):
    """Training folds 0-8 and hold-out fold 9 of the ratings adapter.

    The ratings feed several branches (training side, pairs, probes) and
    model fits; they are persisted (memory, spilling to disk) with their fold,
    so the lineitem x orders join, the aggregation and the key hash run once per query.
    """
    from pyspark import StorageLevel
    folded = add_fold(ratings_from_orders(spark, d), KEYS, 10).persist(StorageLevel.MEMORY_AND_DISK)
    return folded.filter("fold <> 9").drop("fold"), folded.filter("fold = 9").drop("fold")


# ---------------------------------------------------------------- phase 1: kNN
@register("ratings_from_orders")
def q_ratings(spark, d):
    return ratings_from_orders(spark, d)


@register("lattice_neighbors")
def q_lattice_neighbors(spark, d):
    train, test = rating_split(spark, d)
    return lattice_neighbors(train, test, 1.5).select(
        "test_user", "test_item", "train_user", "train_item", "rating", F.bround("dist", 9).alias("dist"))


@register("knn_predict_ratings")
def q_knn_predict(spark, d):
    train, test = rating_split(spark, d)
    return knn_predict(test, lattice_neighbors(train, test, 1.5))


@register("knn_metrics")
def q_knn_metrics(spark, d):
    m = regression_metrics(q_knn_predict(spark, d), "rating", "prediction")
    return m.select("n", *[F.bround(c, 9).alias(c) for c in ("rmse", "mae", "r2")])


# ------------------------------------------------ phase 2: repair and profiling
from datetime import datetime  # noqa: E402

from tessera.operators import clean  # noqa: E402
from tessera.sources.tables import labelled_documents, load  # noqa: E402

CUTOFF = datetime(2000, 1, 1)


def time_split(spark: SparkSession, d: str):
    """Ratings of orders placed before the cutoff, and the distinct
    (user, item) pairs of later orders: later pairs can name unknown items."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    early = j.filter(F.col("o_orderdate") < F.lit(CUTOFF))
    late = j.filter(F.col("o_orderdate") >= F.lit(CUTOFF))
    train = (early.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
             .agg(F.ceil(F.avg("l_quantity") / 10).cast("int").alias("rating")))
    pairs = late.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).distinct()
    return train, pairs


@register("missing_keys_in_training")
def q_missing(spark, d):
    train, pairs = time_split(spark, d)
    users = clean.missing_keys(pairs, train, "user_id").agg(F.count(F.lit(1)).alias("missing_users"))
    items = clean.missing_keys(pairs, train, "item_id").agg(F.count(F.lit(1)).alias("missing_items"))
    # two one-row aggregates side by side
    return users.select(F.lit(1).alias("k"), "missing_users").join(
        items.select(F.lit(1).alias("k"), "missing_items"), "k").drop("k")


@register("repair_unknown_items")
def q_repair(spark, d):
    train, pairs = time_split(spark, d)
    repaired = clean.repair_unknown(pairs.withColumn("old_item", F.col("item_id")), train)
    return repaired.select("user_id", "old_item", "item_id")


@register("replace_values")
def q_replace(spark, d):
    # B3 with a literal mapping, as in the reference (three items mapped).
    train, _ = rating_split(spark, d)
    return clean.replace_values(train, "item_id", {1: 2, 2: 3, 3: 1}).select("user_id", "item_id", "rating")


@register("filter_user")
def q_filter_user(spark, d):
    return clean.filter_equal(ratings_from_orders(spark, d), "user_id", 7)


@register("null_profile")
def q_null_profile(spark, d):
    train, test = rating_split(spark, d)
    ev = knn_predict(test, lattice_neighbors(train, test, 1.5), keep_evidence=True)
    return clean.null_profile(ev.select("user_id", "item_id", "rating", "pair_rating", "user_rating"))


@register("column_info")
def q_column_info(spark, d):
    return clean.column_info(load(spark, d, "documents"))


@register("numeric_coercion")
def q_numeric(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("tail"))
    return clean.coerce_numeric(pages, "tail").withColumnRenamed("tail", "url_number")


def part_profit(spark: SparkSession, d: str):
    """B9-B10 on items: budget = retail price, revenue = discounted sales,
    profit = budget - revenue (sign as in the reference)."""
    li = load(spark, d, "lineitem")
    revenue = li.groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    part = load(spark, d, "part")
    return (part.join(revenue, part.p_partkey == revenue.l_partkey, "left")
            .select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                    F.col("p_retailprice").alias("budget"), "revenue")
            .withColumn("profit", F.col("budget") - F.col("revenue")))


@register("derived_profit")
def q_profit(spark, d):
    return part_profit(spark, d).select("p_partkey", *[F.bround(c, 4).alias(c) for c in ("budget", "revenue", "profit")])


@register("dedupe_keep_first")
def q_dedupe(spark, d):
    kept = clean.keep_first(part_profit(spark, d), ["p_name"],
                            [F.desc_nulls_last("profit"), F.asc("p_partkey")])
    return kept.select("p_name", "p_partkey", F.bround("profit", 4).alias("profit"))


@register("drop_nulls")
def q_drop_nulls(spark, d):
    train, test = rating_split(spark, d)
    ev = knn_predict(test, lattice_neighbors(train, test, 1.5), keep_evidence=True)
    return clean.drop_nulls(ev.select("user_id", "item_id", "pair_rating", "user_rating"))


# ------------------------------------------------------------- phase 2: splits
from tessera.operators.splits import prefix_split  # noqa: E402


@register("fold_sizes")
def q_fold_sizes(spark, d):
    return (add_fold(ratings_from_orders(spark, d), KEYS, 10).groupBy("fold")
            .agg(F.count(F.lit(1)).alias("n")))


@register("prefix_split")
def q_prefix_split(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    return prefix_split(docs, "doc_id", 400, salt="shuffle")


# ----------------------------------------------------------- phase 4: text
from tessera.operators import textstats as ts  # noqa: E402


def doc_words(spark, d, clean_words: bool):
    return ts.doc_tokens(load(spark, d, "documents"), clean=clean_words)


@register("word_freq_raw")
def q_word_freq_raw(spark, d):
    return ts.word_freq(doc_words(spark, d, False))


@register("word_freq_clean")
def q_word_freq_clean(spark, d):
    return ts.word_freq(doc_words(spark, d, True))


@register("freq_summary")
def q_freq_summary(spark, d):
    raw = ts.freq_summary(ts.word_freq(doc_words(spark, d, False))).withColumn("stage", F.lit("raw"))
    cln = ts.freq_summary(ts.word_freq(doc_words(spark, d, True))).withColumn("stage", F.lit("clean"))
    return raw.unionByName(cln)


@register("top_words")
def q_top_words(spark, d):
    return ts.most_common(ts.word_freq(doc_words(spark, d, True)), 10)


@register("rank_range_words")
def q_rank_range(spark, d):
    return ts.rank_range(ts.word_freq(doc_words(spark, d, True)), 1991, 2000)


@register("corpus_counts")
def q_corpus_counts(spark, d):
    lab = ts.doc_tokens(labelled_documents(spark, d), keep=["label"])
    return ts.corpus_counts(lab)


@register("word_degrees")
def q_word_degrees(spark, d):
    return ts.word_degrees(load(spark, d, "documents"))


@register("key_words")
def q_key_words(spark, d):
    return ts.key_words(load(spark, d, "documents"), 10)


@register("tfidf_top_terms")
def q_tfidf(spark, d):
    scored = ts.tfidf(doc_words(spark, d, False), clean=True)
    return ts.top_terms(scored, 5).select("doc_id", "rank", "term", "tf", "df",
                                          F.bround("tfidf", 6).alias("tfidf"))


# ------------------------------------------------------ phase 4: naive Bayes
from tessera.operators import classify as nb  # noqa: E402
from tessera.functions.columns import key_hash_bucket  # noqa: E402


def nb_inputs(spark, d):
    # the tokenised corpus feeds the vocabulary, the class list and the scores:
    # persisted once (recomputable from the scan if an executor is lost)
    docs = ts.doc_tokens(labelled_documents(spark, d), clean=True, keep=["label"])
    docs = docs.withColumn("is_test", key_hash_bucket(["doc_id"], 5, "nb") == 0).persist()
    vocab = nb.vocabulary(docs, 2000)
    present = nb.presence(docs, vocab, keep=["label", "is_test"])
    train_docs = docs.filter(~F.col("is_test")).select("doc_id", "label")
    model = nb.fit_nb(present.filter(~F.col("is_test")), train_docs, vocab)
    return docs, vocab, present, model


@register("presence_features")
def q_presence(spark, d):
    docs = ts.doc_tokens(labelled_documents(spark, d), clean=True, keep=["label"])
    return nb.presence(docs, nb.vocabulary(docs, 2000))


@register("nb_class_word_counts")
def q_nb_counts(spark, d):
    docs, vocab, present, model = nb_inputs(spark, d)
    return nb.class_word_counts(present.filter(~F.col("is_test")))


@register("nb_priors")
def q_nb_priors(spark, d):
    model = nb_inputs(spark, d)[3]
    return model.class_stats.select("label", "n_docs", F.bround("prior", 9).alias("prior"))


@register("nb_likelihoods")
def q_nb_likelihoods(spark, d):
    model = nb_inputs(spark, d)[3]
    return model.theta.select("label", "word", "n_cw", F.bround("theta", 9).alias("theta"))


def nb_predicted(spark, d):
    docs, vocab, present, model = nb_inputs(spark, d)
    pred = nb.predict_nb(model, present, docs.select("doc_id"))
    return docs.select("doc_id", "label", "is_test").join(pred, "doc_id"), model


@register("nb_predictions")
def q_nb_predictions(spark, d):
    pred, model = nb_predicted(spark, d)
    return pred.filter("is_test").select("doc_id", "label", "prediction",
                                         *[F.bround(f"p_{c}", 6).alias(f"p_{c}") for c in model.classes])


@register("nb_accuracy")
def q_nb_accuracy(spark, d):
    pred, _ = nb_predicted(spark, d)
    return (pred.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"),
                                        F.bround(F.avg((F.col("prediction") == F.col("label")).cast("double")), 9)
                                        .alias("accuracy")))


@register("nb_informative")
def q_nb_informative(spark, d):
    model = nb_inputs(spark, d)[3]
    return nb.informative_features(model, 10).select("word", "present", F.bround("ratio", 6).alias("ratio"),
                                                     "label_max")


# ------------------------------------------------------- phase 3: regression
from tessera.operators import regress  # noqa: E402
from tessera.operators.neighbors import lsh_similarity_join  # noqa: E402


@register("ridge_coefficients")
def q_ridge_coefficients(spark, d):
    train, _ = rating_split(spark, d)
    model = regress.fit_ridge(train, ["user_id", "item_id"], "rating", 0.3)
    return model.coefficients().select("term", F.bround("value", 9).alias("value"))


@register("ridge_closed_form")
def q_ridge_closed(spark, d):
    train, _ = rating_split(spark, d)
    cf = regress.ridge_closed_form(train, "user_id", "item_id", "rating", 0.3)
    return cf.select(*[F.bround(c, 9).alias(c) for c in ("b1", "b2", "b0")])


@register("ridge_predictions")
def q_ridge_predictions(spark, d):
    train, test = rating_split(spark, d)
    model = regress.fit_ridge(train, ["user_id", "item_id"], "rating", 0.3)
    return model.transform(test).select("user_id", "item_id", "rating", F.bround("prediction", 6).alias("prediction"))


@register("ridge_metrics")
def q_ridge_metrics(spark, d):
    train, _ = rating_split(spark, d)
    model = regress.fit_ridge(train, ["user_id", "item_id"], "rating", 0.3)
    m = regression_metrics(model.transform(train), "rating", "prediction")
    return m.select("n", *[F.bround(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


@register("ridge_summary")
def q_ridge_summary(spark, d):
    train, _ = rating_split(spark, d)
    return regress.fit_ridge(train, ["user_id", "item_id"], "rating", 0.3).summary_rows()


@register("forest_predictions")
def q_forest_predictions(spark, d):
    train, test = rating_split(spark, d)
    model = regress.fit_forest(train, ["user_id", "item_id"], "rating")
    return model.transform(test).select("user_id", "item_id", "rating", "prediction")


@register("forest_importances")
def q_forest_importances(spark, d):
    train, _ = rating_split(spark, d)
    return regress.fit_forest(train, ["user_id", "item_id"], "rating").importances()


@register("lsh_neighbors")
def q_lsh_neighbors(spark, d):
    train, test = rating_split(spark, d)
    a = train.select("user_id", "item_id", "rating", F.array(F.col("user_id").cast("double"),
                                                          F.col("item_id").cast("double")).alias("features"))
    b = test.select("user_id", "item_id", F.array(F.col("user_id").cast("double"),
                                                   F.col("item_id").cast("double")).alias("features"))
    j = lsh_similarity_join(a, b, 1.5, "features", bucket_length=5.0, num_tables=8, seed=42,
                            a_cols=["user_id", "item_id", "rating"], b_cols=["user_id", "item_id"])
    return j.select(F.col("b_user_id").alias("test_user"), F.col("b_item_id").alias("test_item"),
                    F.col("a_user_id").alias("train_user"), F.col("a_item_id").alias("train_item"),
                    F.col("a_rating").alias("rating"), F.bround("dist", 9).alias("dist"))


# --------------------------------------------------- phase 6: factor models
from tessera.operators import factors as fx  # noqa: E402
from tessera.sources.tables import embedding_vectors  # noqa: E402


@register("baseline_predictions")
def q_baseline(spark, d):
    train, test = rating_split(spark, d)
    model = fx.fit_baseline(train)
    return model.transform(test).select("user_id", "item_id", "rating", F.bround("prediction", 6).alias("prediction"))


@register("baseline_cv")
def q_baseline_cv(spark, d):
    from pyspark import StorageLevel
    folded = add_fold(ratings_from_orders(spark, d), KEYS, 5, salt="cv").persist(StorageLevel.MEMORY_AND_DISK)
    _, test = fx.cv_copies(folded, "fold", 5)
    pred = fx.fit_baseline(folded, by=["cv_fold"], held_out=("fold", 5)).transform(test)
    e = F.col("prediction") - F.col("rating")
    return pred.groupBy(F.col("cv_fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.bround(F.avg(F.abs(e)), 6).alias("mae"))


@register("als_predictions")
def q_als(spark, d):
    train, test = rating_split(spark, d)
    model = fx.fit_factors(train, rank=50, reg=0.1, iters=10)
    return model.transform(test).select("user_id", "item_id", "rating", "prediction", "prediction_int")


@register("item_means")
def q_item_means(spark, d):
    return fx.item_mean(ratings_from_orders(spark, d)).select("item_id", F.bround("mean", 9).alias("mean"))


@register("matrix_extent")
def q_extent(spark, d):
    return fx.matrix_extent(ratings_from_orders(spark, d))


@register("utility_triples")
def q_utility(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    od = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ev = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("rating"), "o_orderdate", "l_orderkey", "l_linenumber")
    # the line key is not unique in the data: the rating itself breaks the last ties
    return fx.utility_triples(ev, ["o_orderdate", "l_orderkey", "l_linenumber", "rating"])


@register("sparse_triples")
def q_sparse(spark, d):
    t = fx.dense_to_triples(embedding_vectors(spark, d), "item_id", "vec")
    return t.select("item_id", "col", "value")


@register("dense_roundtrip")
def q_dense_roundtrip(spark, d):
    ev = embedding_vectors(spark, d)
    back = fx.triples_to_dense(fx.dense_to_triples(ev, "item_id", "vec"), "item_id", 64, keys=ev)
    return ev.join(back.withColumnRenamed("vec", "back"), "item_id", "left").select(
        "item_id", (F.col("vec") == F.col("back")).alias("same"))


@register("embedding_covariance")
def q_covariance(spark, d):
    return fx.covariance(embedding_vectors(spark, d)).select("i", "j", F.bround("cov", 9).alias("cov"))


@register("top_cosine_vectors")
def q_top_cosine(spark, d):
    return fx.top_cosine(embedding_vectors(spark, d), "item_id", 0, 10).select(
        "item_id", F.bround("score", 6).alias("score"), "rank")


@register("pca_item_factors")
def q_pca(spark, d):
    ev = embedding_vectors(spark, d)
    comp = fx.fit_pca(ev, 16)
    return fx.pca_scores(ev, comp, "item_id")


@register("pca_top_cosine")
def q_pca_top(spark, d):
    ev = embedding_vectors(spark, d)
    scores = fx.pca_scores(ev, fx.fit_pca(ev, 16), "item_id").withColumnRenamed("factors", "vec")
    return fx.top_cosine(scores, "item_id", 0, 10)


@register("als_item_top_cosine")
def q_als_top(spark, d):
    train, _ = rating_split(spark, d)
    f = fx.fit_factors(train, rank=50, reg=0.1, iters=10).item_factors()
    return fx.top_cosine(f, "item_id", 1, 10)


# ------------------------------------------- phase 5: content-based on parts
from tessera.operators import content  # noqa: E402
from tessera.functions.parse import json_field, year_of  # noqa: E402


def part_bags(spark, d):
    part = load(spark, d, "part")
    return content.bag_of_words(part, "p_partkey", lists=[F.array(F.lower("p_type"))],
                                texts=[F.lower("p_brand")], numbers=["p_size"], keyword_text="p_name", k=10)


@register("bag_of_words_parts")
def q_bags(spark, d):
    return part_bags(spark, d)


@register("count_vectors_parts")
def q_count_vectors(spark, d):
    return content.count_vectors(part_bags(spark, d), "p_partkey")


@register("recommend_similar_parts")
def q_recommend(spark, d):
    cv = content.count_vectors(part_bags(spark, d), "p_partkey")
    return content.recommend_similar(cv, "p_partkey", 1, 10).select(
        "p_partkey", F.bround("score", 6).alias("score"), "rank")


@register("jaccard_to_query_part")
def q_jaccard(spark, d):
    cv = content.count_vectors(part_bags(spark, d), "p_partkey")
    return content.jaccard_to_query(cv, "p_partkey", 1).select("p_partkey", F.bround("jaccard", 9).alias("jaccard"))


@register("json_props_field")
def q_json(spark, d):
    return load(spark, d, "events").select("event_id", json_field("props", "$.k").cast("int").alias("k"))


@register("order_year")
def q_year(spark, d):
    return load(spark, d, "orders").select("o_orderkey", year_of(F.col("o_orderdate").cast("string")).alias("year"))


# ------------------------------------------- phase 6/7: SVD, method comparison
from tessera.operators import itemcf  # noqa: E402
from tessera.operators.evaluate import Method, describe_folds, describe_forest, describe_ridge, evaluated  # noqa: E402


def svd_of_training(spark, d):
    train, _ = rating_split(spark, d)
    return fx.item_factors_svd(train, k=50, iters=10)


@register("svd_singular_values")
def q_svd_values(spark, d):
    res = svd_of_training(spark, d)
    return spark.createDataFrame([(i + 1, s, e) for i, (s, e) in enumerate(zip(res.singular_values, res.eigenvalues))],
                                 "component int, singular_value double, eigenvalue double")


@register("svd_top_cosine")
def q_svd_top(spark, d):
    return fx.top_cosine(svd_of_training(spark, d).factors, "item_id", 1, 10)


def rating_methods(spark, d) -> dict[str, Method]:
    """The rating methods over one split, each with what its report shows."""
    train, test = rating_split(spark, d)
    ids = ["user_id", "item_id"]
    folded = add_fold(train, KEYS, 5, salt="cv").persist()

    def by_lsh():
        vectors = F.array(F.col("user_id").cast("double"), F.col("item_id").cast("double")).alias("features")
        j = lsh_similarity_join(train.select(*ids, "rating", vectors), test.select(*ids, vectors), 1.5, "features", 5.0, 8, 42,
                                a_cols=[*ids, "rating"], b_cols=ids)
        return j.select(F.col("b_user_id").alias("test_user"), F.col("b_item_id").alias("test_item"), F.col("a_user_id").alias("train_user"),
                        F.col("a_item_id").alias("train_item"), F.col("a_rating").alias("rating"), "dist").persist()
    return {
        "lsh": Method(by_lsh, lambda near: knn_predict(test, near), force=lambda near: [near]),
        "knn_lattice": Method(lambda: lattice_neighbors(train, test, 1.5).persist(), lambda near: knn_predict(test, near), force=lambda near: [near]),
        "ridge": Method(lambda: regress.fit_ridge(train, ids), lambda m: m.transform(test), describe=describe_ridge),
        "forest": Method(lambda: regress.fit_forest(train, ids), lambda m: m.transform(test), describe=describe_forest),
        "baseline": Method(lambda: fx.fit_baseline(train), lambda m: m.transform(test), force=lambda m: [m.b_item, m.b_user]),
        "als": Method(lambda: fx.fit_factors(train, rank=50), lambda m: m.transform(test),
                      describe=lambda m: describe_folds(fx.factors_cv(folded, "fold", 5, rank=50))),
        "item_cf": Method(lambda: itemcf.hashed_profiles(train).persist(), lambda v: itemcf.item_cf_predict(train, test, v), force=lambda v: [v]),
    }


@register("method_comparison")
def q_methods(spark, d):
    """P5 + A11: for each rating method hold-out metrics, fit and prediction seconds of full executions, coefficients,
    objective, importances and the cross-validation table."""
    return evaluated(spark, rating_methods(spark, d))


# ----------------------------------------- remaining inventory lines
from tessera.operators.metrics import residuals  # noqa: E402
from tessera.operators.splits import hash_sample  # noqa: E402


@register("recommend_similar_titles")
def q_recommend_titles(spark, d):
    """F6 + C4: the recommendations with their names (lookup join on the key)."""
    rec = q_recommend(spark, d)
    names = load(spark, d, "part").select("p_partkey", "p_name")
    return rec.join(names, "p_partkey").select("rank", "p_partkey", "p_name", "score")


@register("ridge_residuals")
def q_ridge_residuals(spark, d):
    train, _ = rating_split(spark, d)
    model = regress.fit_ridge(train, ["user_id", "item_id"], "rating", 0.3)
    return residuals(model.transform(train)).select("user_id", "item_id", F.bround("residual", 6).alias("residual"))


@register("top_profit_parts")
def q_top_profit(spark, d):
    """highest profit first, first three rows."""
    return (part_profit(spark, d).orderBy(F.desc_nulls_last("profit"), F.asc("p_partkey")).limit(3)
            .select("p_partkey", "p_name", F.bround("profit", 4).alias("profit")))


@register("hash_sample_user")
def q_hash_sample(spark, d):
    """H2 (exact form): 90 % of one user's ratings by key hash."""
    return hash_sample(clean.filter_equal(ratings_from_orders(spark, d), "user_id", 7), 0.9, KEYS, "sample")


@register("item_item_cosine")
def q_item_cosine(spark, d):
    return content.item_cosine_to(ratings_from_orders(spark, d), 1, 10).select(
        "item_id", F.bround("score", 6).alias("score"), "rank")


@register("als_cv")
def q_als_cv(spark, d):
    """H3 for the latent-factor model: 5 key-hash folds in one fit, RMSE and MAE per fold."""
    folded = add_fold(ratings_from_orders(spark, d), KEYS, 5, salt="cv").persist()
    return fx.factors_cv(folded, "fold", 5, rank=50)


# ------------------------- similar profiles, query sets, the centred matrix
from tessera.operators import blocked, implicit, sgd, similarity, vector_lsh  # noqa: E402


@register("item_cf_predictions")
def q_item_cf(spark, d):
    """Hold-out pairs from the user's ratings of the 20 most similar items."""
    train, test = rating_split(spark, d)
    out = itemcf.item_cf_predict(train, test, itemcf.hashed_profiles(train), 20)
    return out.select("user_id", "item_id", "rating", F.bround("prediction", 6).alias("prediction"), "n_neighbors")


@register("minhash_part_pairs")
def q_minhash(spark, d):
    """Parts whose bags of words have a Jaccard index of 0.7 or more, between representatives of equal bags."""
    terms = content.count_vectors(part_bags(spark, d), "p_partkey").select("p_partkey", "term")
    pairs, _ = similarity.minhash_pairs(terms, "p_partkey", "term", 0.7, recall=0.99999)
    return pairs.select("a", "b", F.bround("jaccard", 9).alias("jaccard"))


@register("minhash_part_classes")
def q_minhash_classes(spark, d):
    """The representative of every part's bag."""
    terms = content.count_vectors(part_bags(spark, d), "p_partkey").select("p_partkey", "term")
    return similarity.minhash_pairs(terms, "p_partkey", "term", 0.7)[1].select(F.col("key").alias("p_partkey"), "rep")


@register("column_similarities")
def q_columns(spark, d):
    """Item pairs whose estimated rating cosine is 0.1 or more, from sampled products."""
    from pyspark import StorageLevel
    est = similarity.column_similarities(ratings_from_orders(spark, d).persist(StorageLevel.MEMORY_AND_DISK), 0.1)
    return est.filter("cosine >= 0.1").select("a", "b", F.bround("cosine", 6).alias("cosine"))


@register("lsh_vector_pairs")
def q_vector_pairs(spark, d):
    """C1/J1 on real vectors: parts whose (price, size) lie within 1.05 of each other."""
    part = load(spark, d, "part").select("p_partkey", F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")).alias("vec"))
    pairs, _ = vector_lsh.vector_pairs(part, "p_partkey", 1.05, 8.0)
    return pairs.select("a", "b", F.bround("dist", 6).alias("dist"))


@register("top_cosine_query_set")
def q_top_cosine_set(spark, d):
    """F5/C5 for a set: the ten vectors nearest to each of fifty."""
    ev = embedding_vectors(spark, d)
    return blocked.top_cosine_queries(ev, "item_id", spark.range(50), 10).select("query", "item_id", F.bround("score", 6).alias("score"), "rank")


@register("euclidean_to_query")
def q_euclidean(spark, d):
    """The ten vectors at the least Euclidean distance of vector 0."""
    return content.nearest_euclidean(embedding_vectors(spark, d), "item_id", 0, 10).select("item_id", F.bround("dist", 6).alias("dist"), "rank")


@register("item_item_cosine_set")
def q_item_cosine_set(spark, d):
    """P1 for a set of items: the ten items with the most similar rating columns."""
    items = spark.range(1, 21).toDF("item_id")
    return content.column_cosines(ratings_from_orders(spark, d), items, 10).select("query", "item_id", F.bround("score", 6).alias("score"), "rank")


@register("user_user_cosine_set")
def q_user_cosine_set(spark, d):
    """P1, the users' side: the ten users with the most similar rating rows."""
    users = spark.range(1, 21).toDF("user_id")
    return content.column_cosines(ratings_from_orders(spark, d), users, 10, user="item_id", item="user_id").select(
        "query", "user_id", F.bround("score", 6).alias("score"), "rank")


@register("centred_entries")
def q_centred(spark, d):
    """Hold-out cells of the item-centred training matrix, minus the item's mean where there is no rating."""
    train, test = rating_split(spark, d)
    m = implicit.centred_matrix(train)
    return m.entry(test.select("item_id", "user_id"), "item_id", "user_id").select("item_id", "user_id", F.bround("value", 9).alias("value"))


@register("scaled_inner_products")
def q_inner(spark, d):
    """D6 pair form, I6: covariances of neighbouring items' rating columns, from the centred matrix scaled by one over the
    root of the number of users."""
    m = implicit.centred_matrix(ratings_from_orders(spark, d))
    pairs = m.row_index.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return m.scaled(m.n_cols ** -0.5).inner_products(pairs, "a", "b").filter("product is not null").select("a", "b", F.bround("product", 9).alias("cov"))


@register("rating_covariance_factors")
def q_covariance_pca(spark, d):
    """50 principal components of the items' covariance rows."""
    train, _ = rating_split(spark, d)
    return implicit.covariance_pca(implicit.centred_matrix(train), 50, iters=8)[0]


@register("rating_covariance_top_cosine")
def q_covariance_top(spark, d):
    """J13 + F5: the ten items nearest to item 1 by those components."""
    return fx.top_cosine(q_covariance_pca(spark, d), "item_id", 1, 10, vec="factors")


@register("sgd_predictions")
def q_sgd(spark, d):
    """J8 by gradient descent, as the surveyed factoriser trains: 50 factors, 20 passes over the ratings."""
    train, test = rating_split(spark, d)
    return sgd.fit_sgd(train, rank=50, epochs=5, passes=4).transform(test).select("user_id", "item_id", "rating", "prediction", "prediction_int")


def item_split(spark, d):
    """Ratings of all items but those of one hash fold of ten, and every fiftieth pair of any item: pairs of unknown items occur.

    Ratings and hashes are made once and persisted (memory, spilling to disk): a repair reads both sides several times.
    """
    from pyspark import StorageLevel
    ratings = ratings_from_orders(spark, d).withColumn("known", key_hash_bucket(["item_id"], 10, "new") != 0) \
        .withColumn("asked", key_hash_bucket(KEYS, 50, "ask") == 0).persist(StorageLevel.MEMORY_AND_DISK)
    return ratings.filter("known").drop("known", "asked"), ratings.filter("asked").select("user_id", "item_id")


@register("missing_keys_by_item")
def q_missing_by_item(spark, d):
    """G1 where items are missing."""
    train, pairs = item_split(spark, d)
    return clean.missing_keys(pairs, train, "item_id")


@register("repair_items_by_item")
def q_repair_by_item(spark, d):
    """B4 + B5 where unknown items occur and are replaced."""
    train, pairs = item_split(spark, d)
    return clean.repair_unknown(pairs.withColumn("old_item", F.col("item_id")), train).select("user_id", "old_item", "item_id")
