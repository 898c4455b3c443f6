"""Latent factors, baselines and matrix statistics.

Ratings stay sparse triples ``(user_id, item_id, rating)`` throughout; no
users x items or items x items matrix is ever materialised. Dense algebra is
limited to vectors whose width is a parameter (factor rank, embedding size).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import clip, cosine, dot, lit_array
from tessera.operators.als import fit_als
from tessera.operators.implicit import centred_matrix, dense_index, row_svd
from tessera.operators.skew import hot_keys, salted_join
from tessera.session import ensure_checkpoint_dir

BLOCK_RATINGS = 10_000   # least ratings of an ALS block, on average
MOST_RATINGS = 1 << 22   # most ratings of an ALS block, on average
BLOCKS = 16              # blocks a side that are enough for that many ratings: each sends its factors to all of the other side


# ------------------------------------------------------------------ statistics
def matrix_extent(ratings: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Largest ids, distinct counts and stored cells, one aggregate pass
    (distinct counts are exact)."""
    return ratings.agg(F.max(item).alias("max_item"), F.max(user).alias("max_user"),
                       F.countDistinct(user).alias("n_users"), F.countDistinct(item).alias("n_items"),
                       F.count(F.lit(1)).alias("n_ratings"))


def item_mean(ratings: DataFrame, n_users: int | None = None, user: str = "user_id", item: str = "item_id",
              rating: str = "rating") -> DataFrame:
    """Mean per item over all users, an absent rating counting as 0
    (sum / number of users). ``n_users`` defaults to the distinct users."""
    if n_users is None:
        n_users = ratings.select(user).distinct().count()
    return ratings.groupBy(item).agg((F.sum(rating) / F.lit(float(n_users))).alias("mean"))


def utility_triples(events: DataFrame, order: list[str], user: str = "user_id", item: str = "item_id",
                    rating: str = "rating") -> DataFrame:
    """I4: one rating per (user, item), the last one in ``order`` wins
    (``max_by`` aggregate: combines map-side, no sort of a user's history)."""
    key = F.struct(*[F.col(c) for c in order])
    return events.groupBy(user, item).agg(F.max_by(F.col(rating), key).alias(rating))


def dense_to_triples(df: DataFrame, key: str, vec: str) -> DataFrame:
    """I8: dense array rows -> ``(key, col, value)`` for non-zero cells."""
    return (df.select(key, F.posexplode(vec).alias("col", "value")).filter(F.col("value") != 0))


def triples_to_dense(triples: DataFrame, key: str, width: int, keys: DataFrame | None = None) -> DataFrame:
    """I8: ``(key, col, value)`` -> ``(key, vec)`` of length ``width``, absent = 0.
    A row's cells are bounded by ``width``. An all-zero row has no triple; ``keys``
    (a frame with the key column) brings such rows back."""
    m = triples.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    if keys is not None:
        m = keys.select(key).distinct().join(m, key, "left")
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                     lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vec"))


def covariance(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Population covariance of the vector dimensions, ``(i, j, cov)``.

    Correlation (JVM ``treeAggregate`` of a d x d Gram) times population
    standard deviations; the d x d result is bounded by the width.
    """
    v = vectors.select(array_to_vector(vec).alias("v"))
    corr = Correlation.corr(v, "v").collect()[0][0].toArray()
    stats = v.select(Summarizer.metrics("std", "count").summary(F.col("v")).alias("s")).collect()[0]["s"]
    n = stats["count"]
    sd = stats["std"].toArray() * ((n - 1) / n) ** 0.5
    d = len(sd)
    # a constant dimension has no correlation (NaN) but covariance 0
    rows = [(i, j, float(corr[i, j] * sd[i] * sd[j]) if sd[i] > 0 and sd[j] > 0 else 0.0) for i in range(d) for j in range(d)]
    return vectors.sparkSession.createDataFrame(rows, "i int, j int, cov double")


# -------------------------------------------------------------------- baseline
@dataclass
class Baseline:
    mu: DataFrame       # (by..., mu, n): one row per group, on the driver
    b_item: DataFrame   # (by..., item, b_i, n_i), persisted
    b_user: DataFrame   # (by..., user, b_u, n_u), persisted
    by: list[str]
    user: str
    item: str
    n: int              # training rows

    def transform(self, pairs: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
        """J10 predict: mu + b_u + b_i (unknown -> 0), clipped to the scale."""
        out = with_mean(pairs, self.mu, self.by)
        on_item, on_user = [*self.by, self.item], [*self.by, self.user]
        out = salted_join(out, self.b_item.drop("n_i"), on_item, hot_keys(self.b_item, on_item, "n_i", self.n), [self.user], "left")
        out = salted_join(out, self.b_user.drop("n_u"), on_user, hot_keys(self.b_user, on_user, "n_u", self.n), [self.item], "left")
        est = F.col("mu") + F.coalesce("b_u", F.lit(0.0)) + F.coalesce("b_i", F.lit(0.0))
        return out.withColumn("baseline", est).withColumn("prediction", clip(est, low, high)) \
            .drop("mu", "b_u", "b_i")

    def release(self) -> None:
        """Drop the persisted offsets (after the last use of what ``transform`` returned)."""
        self.b_item.unpersist()
        self.b_user.unpersist()


def with_mean(df: DataFrame, mu: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the mean of its group (``mu``: one row per group)."""
    means = F.broadcast(mu.drop("n"))
    return df.join(means, by) if by else df.withColumn("mu", F.lit(mu.first()["mu"]).cast("double"))


def fit_baseline(ratings: DataFrame, reg_item: float = 10.0, reg_user: float = 15.0, by: list[str] | None = None,
                 user: str = "user_id", item: str = "item_id", rating: str = "rating",
                 held_out: tuple[str, int] | None = None) -> Baseline:
    """Global mean plus damped item and user offsets:
    b_i = sum(r - mu) / (reg_item + n_i);  b_u = sum(r - mu - b_i) / (reg_user + n_u).

    ``by`` fits one model per group (e.g. per cross-validation fold; few groups)
    in the same plan. All three are hash aggregates with map-side combine; the
    groups' means are read once, the offsets are persisted, and hot items and
    users are salted where offsets are joined back.

    With ``held_out`` (a column of folds 0 to k - 1, and k) ``by`` names the one
    column of the k models: model f is fitted to the rows of all folds but f, as
    if to the copies of :func:`cv_copies`, but every row moves once.
    """
    by = list(by or [])
    if held_out:
        return _fit_without_folds(ratings, *held_out, reg_item, reg_user, by[0], user, item, rating)
    r = F.col(rating).cast("double")
    mu = ratings.groupBy(*by).agg(F.avg(r).alias("mu"), F.count(F.lit(1)).alias("n"))
    groups = mu.collect()
    mu, n = ratings.sparkSession.createDataFrame(groups, mu.schema), sum(g["n"] for g in groups)
    with_mu = with_mean(ratings, mu, by)
    on_item = [*by, item]
    b_item = with_mu.groupBy(*on_item).agg((F.sum(r - F.col("mu")) / (reg_item + F.count(F.lit(1)))).alias("b_i"),
                                           F.count(F.lit(1)).alias("n_i")).persist(StorageLevel.MEMORY_AND_DISK)
    known = salted_join(with_mu, b_item.drop("n_i"), on_item, hot_keys(b_item, on_item, "n_i", n), [user])
    b_user = known.groupBy(*by, user).agg((F.sum(r - F.col("mu") - F.col("b_i")) / (reg_user + F.count(F.lit(1)))).alias("b_u"),
                                          F.count(F.lit(1)).alias("n_u")).persist(StorageLevel.MEMORY_AND_DISK)
    return Baseline(mu, b_item, b_user, by, user, item, n)


def _fit_without_folds(ratings: DataFrame, fold: str, k: int, reg_item: float, reg_user: float, name: str,
                       user: str, item: str, rating: str) -> Baseline:
    """The k models of :func:`fit_baseline` with ``held_out``: what a model sums over the rows outside its fold is the sum
    over all rows less that over the fold, or one of k sums of the same row."""
    r = F.col(rating).cast("double")
    totals = (F.sum(r).alias("s"), F.count(r).alias("c"), F.count(F.lit(1)).alias("n"))
    found = {g[fold]: g for g in ratings.groupBy(fold).agg(*totals).collect()}

    def outside(f: int, of: str):
        return sum(g[of] or 0 for at, g in found.items() if at != f)
    means = [(f, outside(f, "s") / outside(f, "c") if outside(f, "c") else None, outside(f, "n")) for f in range(k) if outside(f, "n")]
    mu = ratings.sparkSession.createDataFrame(means, f"{name} int, mu double, n bigint")
    n = sum(m[2] for m in means)
    mus = {f: F.lit(m).cast("double") for f, m, _ in means}
    folds = list(mus)

    def exploded(per_key: DataFrame, key: str, offset: str, count: str) -> DataFrame:
        """One row a model and key, as :class:`Baseline` has them; keys without rows outside a fold are unknown to its model."""
        rows = F.explode(F.array(*[F.struct(F.lit(f).alias(name), F.col("b")[i].alias(offset), F.col("ns")[i].alias(count)) for i, f in enumerate(folds)]))
        return per_key.select(key, rows.alias("m")).select(f"m.{name}", key, f"m.{offset}", f"m.{count}").filter(F.col(count) > 0) \
            .persist(StorageLevel.MEMORY_AND_DISK)

    def left(of: str, f: int) -> Column:
        return F.sum(of) - F.coalesce(F.sum(F.when(F.col(fold) == f, F.col(of))), F.lit(0))
    parts = ratings.groupBy(item, fold).agg(*totals)
    per_item = parts.groupBy(item).agg(
        F.array(*[F.when(left("c", f) > 0, (left("s", f) - mus[f] * left("c", f)) / (reg_item + left("n", f))) for f in folds]).alias("b"),
        F.array(*[left("n", f) for f in folds]).alias("ns"), F.sum("n").alias("n_all")).persist(StorageLevel.MEMORY_AND_DISK)
    known = salted_join(ratings.select(user, item, rating, fold), per_item.select(item, "b"), [item],
                        hot_keys(per_item, [item], "n_all", sum(g["n"] for g in found.values())), [user])
    per_user = known.groupBy(user).agg(
        *[F.sum(F.when(F.col(fold) != f, r - mus[f] - F.col("b")[i])).alias(f"s{i}") for i, f in enumerate(folds)],
        *[F.count(F.when(F.col(fold) != f, 1)).alias(f"n{i}") for i, f in enumerate(folds)])
    per_user = per_user.select(user, F.array(*[F.col(f"s{i}") / (reg_user + F.col(f"n{i}")) for i in range(len(folds))]).alias("b"),
                               F.array(*[F.col(f"n{i}") for i in range(len(folds))]).alias("ns"))
    return Baseline(mu, exploded(per_item, item, "b_i", "n_i"), exploded(per_user, user, "b_u", "n_u"), [name], user, item, n)


def cv_copies(ratings: DataFrame, fold: str, k: int, name: str = "cv_fold") -> tuple[DataFrame, DataFrame]:
    """H3 in one plan: every row is copied into the k-1 training sets it
    belongs to (``explode``), and is the test row of its own fold.

    Returns ``(train, test)`` both carrying ``cv_fold``; fitting with
    ``by=["cv_fold"]`` trains all k models in one job.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold).cast("int"))
    train = ratings.withColumn(name, F.explode(others)).drop(fold)
    test = ratings.withColumn(name, F.col(fold).cast("int")).drop(fold)
    return train, test


# ------------------------------------------------------------------------ ALS
@dataclass
class Factors:
    baseline: Baseline
    als: tuple[DataFrame, DataFrame]  # (at, vec) of users' and items' block positions
    users: DataFrame    # (user, at): positions of the known users
    items: DataFrame
    user: str
    item: str
    by: list[str]       # [] or [fold]: models stacked in one fit
    own: int            # blocks a side of a group's own
    groups: int

    def transform(self, pairs: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
        """Baseline + factor term (unknown ids -> baseline only), clipped;
        ``prediction_int`` is rounded half-even."""
        base = positions(self.baseline.transform(pairs, low, high), self.users, self.items, self.user, self.item, self.by, self.own, self.groups)
        return (with_factors(base, self.als).withColumn("prediction", clip(F.col("baseline") + F.col("__f"), low, high))
                .withColumn("prediction_int", F.bround("prediction", 0).cast("int"))
                .drop("__u", "__i", "__f", "baseline"))

    def item_factors(self) -> DataFrame:
        """``(item_id, vec ARRAY<DOUBLE>)`` of a single model."""
        factors = self.als[1].select("at", F.col("vec").cast("array<double>").alias("vec"))
        return factors.join(self.items, "at").select(self.item, "vec")


def with_factors(rows: DataFrame, als: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with the factor term ``__f`` of their positions ``__u`` and ``__i``, 0 where one has no factors."""
    users, items = (x.select(F.col("at").alias(c), F.col("vec").alias(f"{c}v")) for x, c in zip(als, ("__u", "__i")))
    # a block is few rows and many bytes, so its size is underrated: never a broadcast
    both = rows.join(users.hint("merge"), "__u", "left").join(items.hint("merge"), "__i", "left")
    return both.withColumn("__f", F.coalesce(dot("__uv", "__iv").cast("double"), F.lit(0.0))).drop("__uv", "__iv")


def placed(at: str, group: Column, own: int, groups: int) -> Column:
    """The block position of a dense position ``at``.

    ALS deals positions over blocks by their remainder. Stacked models take ``own`` remainders of ``own * groups`` each, so
    no block holds two models and factors only go to the blocks of their own.
    """
    return (F.floor(F.col(at) / own) * (own * groups) + group.cast("long") * own + F.col(at) % own).cast("int")


def positions(rows: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str, by: list[str], own: int, groups: int) -> DataFrame:
    """``rows`` with the dense 32-bit positions ``__u`` and ``__i`` of their ids (see :func:`placed`)."""
    def at(c: str) -> Column:
        return placed(c, F.col(by[0]), own, groups) if by else F.col(c).cast("int")
    return (rows.join(users.select(F.col(user), F.col("at").alias("__pu")), user, "left").join(items.select(F.col(item), F.col("at").alias("__pi")), item, "left")
            .withColumn("__u", at("__pu")).withColumn("__i", at("__pi")).drop("__pu", "__pi"))


def blocks_a_group(spark, n: int, n_users: int, n_items: int, groups: int, blocks: int | None = None) -> int:
    """ALS blocks a side of each of ``groups`` stacked models over ``n`` ratings."""
    # at most one user block and one item block per core, and no more than the
    # ratings fill: blocks route to each other, so what they send grows with their number
    most = min(spark.sparkContext.defaultParallelism, n // BLOCK_RATINGS + 1, BLOCKS)
    own = -(-(blocks or max(most, n // MOST_RATINGS + 1)) // groups)
    if (max(n_users, n_items) // own + 1) * own * groups >= 1 << 31:
        raise ValueError("positions are 32-bit: fewer than 2^31 users and items")
    return own


def fit_factors(ratings: DataFrame, rank: int = 50, reg: float = 0.1, iters: int = 10, seed: int = 42,
                user: str = "user_id", item: str = "item_id", rating: str = "rating",
                blocks: int | None = None, by: list[str] | None = None) -> Factors:
    """Latent factors on the baseline residual (biases + dot product), fitted
    with the block ALS of :mod:`tessera.operators.als`. Ids of any type get dense
    32-bit positions first. Factors are checkpointed in the session's
    ``spark.checkpoint.dir`` each half iteration.

    ``by`` (one integer column, e.g. the cross-validation fold) fits one model per
    group in the same fit: a group's users and items take positions and blocks of
    their own, so the stacked ratings are one block-diagonal matrix, whose factors
    are exactly the groups' own least-squares solutions and stay in its blocks.
    """
    ensure_checkpoint_dir(ratings.sparkSession)
    by = list(by or [])
    base = fit_baseline(ratings, by=by, user=user, item=item, rating=rating)
    users, items = dense_index(ratings, user), dense_index(ratings, item)
    n_users, n_items = users.count(), items.count()
    groups = ratings.agg(F.max(by[0])).first()[0] + 1 if by else 1
    own = blocks_a_group(ratings.sparkSession, base.n, n_users, n_items, groups, blocks)
    resid = positions(base.transform(ratings.select(*by, user, item, rating)), users, items, user, item, by, own, groups) \
        .select("__u", "__i", (F.col(rating) - F.col("baseline")).alias("__r")).filter("__u is not null and __i is not null and __r is not null")
    return Factors(base, fit_als(resid, rank, reg, iters, seed, own * groups), users, items, user, item, by, own, groups)


def factors_cv(ratings: DataFrame, fold: str, k: int, rank: int = 50, reg: float = 0.1, iters: int = 10, seed: int = 42,
               user: str = "user_id", item: str = "item_id", rating: str = "rating") -> DataFrame:
    """H3 for the latent-factor model: ``(fold, n, rmse, mae)``, all ``k`` models in one fit and one pass over the hold-out rows.

    The models are those of :func:`fit_factors` with ``by`` on the copies of :func:`cv_copies`. Here a row meets the
    positions and the ``k`` offsets of its user and of its item once, and is copied to the models when it has them.
    """
    ensure_checkpoint_dir(ratings.sparkSession)
    ratings = ratings.select(user, item, rating, F.col(fold).cast("int").alias("__fold")).filter("__fold is not null")
    base = fit_baseline(ratings, by=["cv_fold"], held_out=("__fold", k), user=user, item=item, rating=rating)
    mus = {m["cv_fold"]: m["mu"] for m in base.mu.collect()}
    users, items = dense_index(ratings, user), dense_index(ratings, item)
    own = blocks_a_group(ratings.sparkSession, base.n, users.count(), items.count(), k)

    def with_offsets(rows: DataFrame, index: DataFrame, offsets: DataFrame, key: str, b: str, n: str, at: str, spread: str) -> DataFrame:
        """``rows`` with the position ``at`` of their ``key`` and its offset in each model, the array ``b``."""
        of = offsets.groupBy(key).agg(F.array(*[F.max(F.when(F.col("cv_fold") == f, F.col(b))) for f in range(k)]).alias(f"__{b}"), F.sum(n).alias(n))
        found = of.join(index.withColumnRenamed("at", at), key, "left")
        return salted_join(rows, found.drop(n), [key], hot_keys(of, [key], n, base.n), [spread], "left")
    known = with_offsets(ratings, items, base.b_item, item, "b_i", "n_i", "__pi", user)
    known = with_offsets(known, users, base.b_user, user, "b_u", "n_u", "__pu", item)
    models = F.array(*[F.lit(f) for f in mus])

    def of_model(rows: DataFrame) -> DataFrame:
        """Rows of the models ``cv_fold`` with their baseline and positions."""
        f = F.col("cv_fold")
        mu = F.array(*[F.lit(mus.get(m)).cast("double") for m in range(k)])[f]
        est = mu + F.coalesce(F.col("__b_u")[f], F.lit(0.0)) + F.coalesce(F.col("__b_i")[f], F.lit(0.0))
        return rows.select(f, F.col(rating), est.alias("baseline"), placed("__pu", f, own, k).alias("__u"), placed("__pi", f, own, k).alias("__i"))
    train = of_model(known.withColumn("cv_fold", F.explode(F.filter(models, lambda f: f != F.col("__fold")))))
    resid = train.select("__u", "__i", (F.col(rating) - F.col("baseline")).alias("__r")).filter("__u is not null and __i is not null and __r is not null")
    fac = fit_als(resid, rank, reg, iters, seed, own * k)
    test = with_factors(of_model(known.withColumn("cv_fold", F.col("__fold")).filter(F.array_contains(models, F.col("cv_fold")))), fac)
    e = clip(F.col("baseline") + F.col("__f"), 1.0, 5.0) - F.col(rating)
    return test.groupBy(F.col("cv_fold").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


# ---------------------------------------------------------------------- PCA/SVD
@dataclass
class Components:
    pc: list[list[float]]        # d x k
    variance: list[float]        # explained variance per component
    mean: list[float]            # d


def fit_pca(vectors: DataFrame, k: int, vec: str = "vec") -> Components:
    """Top-``k`` principal components of the rows' dimensions (Spark ML
    PCA: a d x d covariance from one tree aggregate, eigen-decomposed on the
    driver; d is the vector width)."""
    v = vectors.select(array_to_vector(vec).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    mean = v.select(Summarizer.mean(F.col("v")).alias("m")).collect()[0]["m"].toArray().tolist()
    return Components(model.pc.toArray().tolist(), model.explainedVariance.toArray().tolist(), mean)


def pca_scores(vectors: DataFrame, comp: Components, key: str, vec: str = "vec") -> DataFrame:
    """Centred projection ``(key, factors)`` (Spark's ``PCAModel`` does not
    centre, so the mean is subtracted first). The d x k matrix is a literal."""
    centred = F.zip_with(F.col(vec), lit_array(comp.mean), lambda x, m: x - m)
    return vectors.select(key, centred.alias("__c")).select(
        key, _times_matrix("__c", np.asarray(comp.pc)).alias("factors"))


def top_cosine(vectors: DataFrame, key: str, query, n: int = 10, vec: str = "vec",
               include_self: bool = True) -> DataFrame:
    """the ``n`` rows most cosine-similar to row ``query`` (ties by key).

    The query vector (width d) is fetched once and inlined as a literal, so
    scoring is a narrow projection and the top-n is a TakeOrderedAndProject.
    Rows with norm 0 have no cosine and are dropped.
    """
    q = vectors.filter(F.col(key) == F.lit(query)).select(vec).limit(1).collect()
    if not q:
        return vectors.sparkSession.createDataFrame([], f"{key} bigint, score double, rank int")
    qv = lit_array(q[0][0])
    scored = vectors.select(key, cosine(F.col(vec), qv).alias("score")).filter(F.col("score").isNotNull())
    if not include_self:
        scored = scored.filter(F.col(key) != F.lit(query))
    top = scored.orderBy(F.desc("score"), F.asc(key)).limit(n)
    from pyspark.sql import Window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))


def _times_matrix(vec: str, m) -> Column:
    """Row vector times a small literal matrix ``m`` (k x k'), the matrix being
    one flattened array literal indexed inside the lambda."""
    kin, kout = m.shape
    flat = "array(" + ", ".join(f"{float(x):.17E}D" for x in np.asarray(m).ravel()) + ")"
    return F.expr(f"transform(sequence(0, {kout - 1}), j -> aggregate(sequence(0, {kin - 1}), 0D, "
                  f"(acc, i) -> acc + {vec}[i] * {flat}[i * {kout} + j]))")


@dataclass
class SVDResult:
    factors: DataFrame          # (item, vec): top-k right singular vectors, one row per item
    singular_values: list[float]
    eigenvalues: list[float]    # of the population item covariance


def item_factors_svd(ratings: DataFrame, k: int = 50, iters: int = 10, oversample: int = 10, seed: int = 42,
                     user: str = "user_id", item: str = "item_id", rating: str = "rating") -> SVDResult:
    """Top-``k`` right singular vectors of the item-centred users x items
    matrix (absent = 0, each item centred by its mean over all users), i.e. the
    item factors of a truncated SVD; equals PCA of the user rows.

    Subspace iteration on the implicit matrix of :mod:`tessera.operators.implicit`
    (items as rows, so the factors are its left singular vectors): neither the
    matrix nor the item covariance is formed, products move blocks, and only
    k x k matrices reach the driver. Every product is checkpointed
    (``spark.checkpoint.dir``); the iteration ends early when the leading values
    stand still.
    """
    matrix = centred_matrix(ratings, item, user, rating)
    factors, values = row_svd(matrix, k, iters, oversample, seed)
    return SVDResult(factors, [v / max(matrix.n_rows - 1, 1) ** 0.5 for v in values], [v * v / matrix.n_cols for v in values])


def first_components(factors: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Factors cut to their first ``k`` components (leading ones come first)."""
    return factors.withColumn(vec, F.slice(vec, 1, k))
