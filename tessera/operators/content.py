"""Content-based recommendation from item metadata.

Items are compared through sparse term-count triples ``(key, term, n)``.
Scoring a query item joins only the query's terms (a handful of rows,
broadcast) with the triples and sums products per item: work is linear in
the triples, and no item x item matrix or pair set is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import euclidean, lit_array
from tessera.functions.text import count_tokens, explode_terms, key_words


def bag_of_words(items: DataFrame, key: str, lists: Sequence[Column | str] = (), texts: Sequence[Column | str] = (),
                 numbers: Sequence[Column | str] = (), keyword_text: Column | str | None = None,
                 k: int = 10) -> DataFrame:
    """``(key, bag)`` where the bag joins, with blanks, the list columns'
    elements, the text columns, numbers as text and the first ``k`` key words
    of ``keyword_text`` (K4-K7, I11)."""
    def col(c):
        return F.col(c) if isinstance(c, str) else c
    parts = [F.array_join(col(c), " ") for c in lists]
    parts += [col(c) for c in texts]
    parts += [col(c).cast("string") for c in numbers]
    if keyword_text is not None:
        parts.append(F.array_join(key_words(col(keyword_text), k), " "))
    return items.select(key, F.concat_ws(" ", *parts).alias("bag"))


def count_vectors(bags: DataFrame, key: str, bag: str = "bag") -> DataFrame:
    """Term counts ``(key, term, n)``; terms are lower-cased runs of two or
    more word characters."""
    return (explode_terms(bags, count_tokens(bag), "term", key)
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")))


def norms(triples: DataFrame, key: str) -> DataFrame:
    return triples.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))


def cosine_to_queries(triples: DataFrame, key: str, queries: DataFrame, n: int = 10,
                      include_self: bool = False) -> DataFrame:
    """C5/F6 for a set of query items: ``(query, key, score, rank)``, the top
    ``n`` items per query by cosine of term counts (ties by key). Items that
    share no term with the query score 0 and fill its last ranks in key order.

    Only the query rows' terms are joined with the triples, so the pairs
    produced are (query, item sharing a term); the number of queries is the
    caller's choice and is what bounds the output. The per-query top-n is a
    ``row_number() <= n`` (partial window-group limit before the shuffle).
    """
    q = (triples.join(queries.select(F.col(key)).distinct(), key, "left_semi")
         .select(F.col(key).alias("query"), "term", F.col("n").alias("qn")))
    nrm = norms(triples, key)
    dots = (triples.join(q, "term").groupBy("query", key).agg(F.sum(F.col("n") * F.col("qn")).alias("dot")))
    qn = nrm.select(F.col(key).alias("query"), F.col("norm").alias("qnorm"))
    scored = (dots.join(nrm, key).join(qn, "query")
              .select("query", key, (F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("score")))
    # A query with fewer than n such items takes zero-score items in key order: of the
    # first 2n + 1 keys at least n share no term with it, so no item is paired with every query.
    first = [r[0] for r in nrm.select(key).orderBy(key).limit(2 * n + 1).collect()]
    if first:
        fill = qn.join(q.select("query").distinct(), "query", "left_semi") \
            .select("query", F.explode(F.array(*[F.lit(x) for x in first])).alias(key))
        fill = fill.join(scored.select("query", key), ["query", key], "left_anti")
        scored = scored.unionByName(fill.withColumn("score", F.lit(0.0)))
    if not include_self:
        scored = scored.filter(F.col("query") != F.col(key))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n) \
        .select("query", key, "score", "rank")


def recommend_similar(triples: DataFrame, key: str, query, n: int = 10, include_self: bool = False) -> DataFrame:
    """top-``n`` items most similar to one item, ``(key, score, rank)``.

    Every item's score is its dot product with it over its norms. Items sharing no term score 0,
    so the top-n over all items equals the reference's sort of the full
    similarity row. Ties by key.
    """
    qt = triples.filter(F.col(key) == F.lit(query)).select("term", F.col("n").alias("qn"))
    qnorm = F.sqrt(F.sum(F.col("qn") * F.col("qn")))
    qn_val = qt.agg(qnorm.alias("q")).collect()[0]["q"]
    nrm = norms(triples, key)
    dots = (triples.join(qt, "term").groupBy(key)
            .agg(F.sum(F.col("n") * F.col("qn")).alias("dot")))
    scored = (nrm.join(dots, key, "left")
              .withColumn("score", F.coalesce(F.col("dot"), F.lit(0)) / (F.lit(qn_val) * F.col("norm"))))
    if not include_self:
        scored = scored.filter(F.col(key) != F.lit(query))
    top = scored.orderBy(F.desc("score"), F.asc(key)).limit(n)
    return top.select(key, "score", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))).alias("rank"))


def jaccard_to_query(triples: DataFrame, key: str, query) -> DataFrame:
    """Jaccard index of each item's term set with the query's term set,
    ``(key, jaccard)`` for items sharing at least one term."""
    qt = triples.filter(F.col(key) == F.lit(query)).select("term").distinct()
    q_size = qt.count()
    sizes = triples.groupBy(key).agg(F.countDistinct("term").alias("size"))
    inter = (triples.join(qt, "term")
             .groupBy(key).agg(F.countDistinct("term").alias("inter")))
    return inter.join(sizes, key).select(
        key, (F.col("inter") / (F.lit(q_size) + F.col("size") - F.col("inter"))).alias("jaccard"))


def item_cosine_to(ratings: DataFrame, query, n: int = 10, user: str = "user_id", item: str = "item_id",
                   rating: str = "rating") -> DataFrame:
    """P1 for one query item: exact cosine between item rating columns (users
    as coordinates, absent = 0), top ``n`` other items, ``(item, score, rank)``.

    Only the ratings of users who rated the query item are joined (a
    shuffle join on user, however many users that is), so the work is linear
    in the ratings and no item pair set is built. Items with no common user
    score 0.
    """
    r = F.col(rating).cast("double")
    q = ratings.filter(F.col(item) == F.lit(query)).select(user, r.alias("__rq"))
    q_norm = q.agg(F.sqrt(F.sum(F.col("__rq") * F.col("__rq")))).collect()[0][0]
    dots = (ratings.join(q, user).groupBy(item).agg(F.sum(r * F.col("__rq")).alias("dot")))
    nrm = ratings.groupBy(item).agg(F.sqrt(F.sum(r * r)).alias("norm"))
    scored = (nrm.join(dots, item, "left").filter(F.col(item) != F.lit(query))
              .withColumn("score", F.coalesce("dot", F.lit(0.0)) / (F.lit(q_norm) * F.col("norm"))))
    top = scored.orderBy(F.desc("score"), F.asc(item)).limit(n)
    return top.select(item, "score", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(item))).alias("rank"))


def column_cosines(ratings: DataFrame, queries: DataFrame, n: int = 10, user: str = "user_id", item: str = "item_id",
                   rating: str = "rating") -> DataFrame:
    """P1 for a set of items (one column): ``(query, item, score, rank)``, the ``n`` other items whose rating columns have
    the highest cosine with each query's, ties by item; items without a common user score 0 and fill the last ranks.

    Only ratings of users who rated a query item are joined, once for each query item they rated: work is linear in the
    ratings for a given set. The query side is written first, so a user with many ratings can be split.
    """
    r = F.col(rating).cast("double")
    asked = ratings.join(queries.select(F.col(queries.columns[0]).alias(item)).distinct(), item, "left_semi")
    q = asked.select(user, F.col(item).alias("query"), r.alias("__rq"))
    dots = ratings.select(user, item, r.alias("__r")).join(q, user).filter(F.col("query") != F.col(item)) \
        .groupBy("query", item).agg(F.sum(F.col("__r") * F.col("__rq")).alias("dot"))
    nrm = ratings.groupBy(item).agg(F.sqrt(F.sum(r * r)).alias("norm"))
    qn = nrm.select(F.col(item).alias("query"), F.col("norm").alias("qnorm")).join(q.select("query").distinct(), "query", "left_semi")
    scored = dots.join(nrm, item).join(qn, "query").select("query", item, (F.col("dot") / (F.col("qnorm") * F.col("norm"))).alias("score"))
    # of the first n + 1 items in order at least n differ from a query: they fill up with score 0 where nothing else does
    first = [x[0] for x in nrm.select(item).orderBy(item).limit(2 * n + 1).collect()]
    if first:
        fill = qn.select("query", F.explode(F.array(*[F.lit(x) for x in first])).alias(item)).filter(F.col("query") != F.col(item))
        scored = scored.unionByName(fill.join(scored.select("query", item), ["query", item], "left_anti").withColumn("score", F.lit(0.0)))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query", item, "score", "rank")


def nearest_euclidean(vectors: DataFrame, key: str, query, n: int = 10, vec: str = "vec") -> DataFrame:
    """``(key, dist, rank)``: the ``n`` other rows at the least Euclidean distance of row ``query``, ties by key.

    The query vector is fetched once and inlined as a literal; the top-n is a
    TakeOrderedAndProject. Null vectors take no part; a null component leaves a row out.
    """
    q = vectors.filter((F.col(key) == F.lit(query)) & F.col(vec).isNotNull()).select(vec).limit(1).collect()
    at = lit_array(q[0][0]) if q else F.lit(None).cast("array<double>")
    near = vectors.filter(F.col(key) != F.lit(query)).select(key, euclidean(vec, at).alias("dist")).filter(F.col("dist").isNotNull())
    top = near.orderBy(F.asc("dist"), F.asc(key)).limit(n)
    return top.select(key, "dist", F.row_number().over(Window.orderBy(F.asc("dist"), F.asc(key))).alias("rank"))
