"""Splits, sampling and cross-validation (H1-H5).

The deterministic forms hash the key (md5), so a row's fold depends only on
its key: no shuffle, no driver round trip, same answer on every run and in
DuckDB. The seeded-random forms wrap Spark's ``randomSplit`` / ``sample``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import key_hash_bucket


def add_fold(df: DataFrame, keys: Sequence[str], k: int = 10, salt: str = "", name: str = "fold") -> DataFrame:
    """H1: fold number in [0, k) from the key hash (narrow projection, no shuffle)."""
    return df.withColumn(name, key_hash_bucket(list(keys), k, salt))


def hash_split(df: DataFrame, keys: Sequence[str], test_folds: Sequence[int] = (9,), k: int = 10,
               salt: str = "") -> tuple[DataFrame, DataFrame]:
    """H1: ``(train, test)`` where test = rows whose fold is in ``test_folds``."""
    fold = key_hash_bucket(list(keys), k, salt)
    test = fold.isin(list(test_folds))
    return df.filter(~test), df.filter(test)


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 42) -> list[DataFrame]:
    """H1 (reference form): Spark's seeded ``randomSplit``."""
    return df.randomSplit(list(weights), seed)


def hash_sample(df: DataFrame, fraction: float, keys: Sequence[str], salt: str = "") -> DataFrame:
    """H2 (exact form): keep a row when its key hash falls under ``fraction``."""
    buckets = 1_000_000
    return df.filter(key_hash_bucket(list(keys), buckets, salt) < int(round(fraction * buckets)))


def random_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """H2 (reference form): Bernoulli sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def prefix_split(df: DataFrame, key: str, n: int, salt: str = "", name: str = "is_test") -> DataFrame:
    """H4: shuffle by a salted hash of ``key``, the first ``n`` rows are test.

    The cut is found with a top-n (TakeOrderedAndProject keeps n rows per task)
    and returned as one scalar, so no row goes through a single partition; the
    flag is then a narrow filter expression.
    """
    order = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    top = (df.select(order.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(n)
           .agg(F.max(F.struct("h", "k")).alias("cut")).collect()[0]["cut"])
    if top is None:
        return df.withColumn(name, F.lit(False))
    cut_h, cut_k = top["h"], top["k"]
    flag = (order < F.lit(cut_h)) | ((order == F.lit(cut_h)) & (F.col(key) <= F.lit(cut_k)))
    return df.withColumn(name, flag)


def cross_validate(df: DataFrame, fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
                   keys: Sequence[str], k: int = 5, label: str = "rating", prediction: str = "prediction",
                   salt: str = "cv") -> DataFrame:
    """H3: k-fold cross-validation with key-hash folds.

    ``fit_predict(train, test)`` returns ``test`` with a ``prediction`` column.
    Each fold's metrics are computed by one aggregate job. ``fit_time`` is what
    ``fit_predict`` takes to return, ``test_time`` the metrics job; work that
    ``fit_predict`` leaves lazy counts as test time. Models that fit all folds at
    once (``factors.factors_cv``, ``factors.cv_copies``) need no such loop.
    Returns ``(fold, rmse, mae, fit_time, test_time)``.
    """
    spark = df.sparkSession
    folded = df.withColumn("__fold", key_hash_bucket(list(keys), k, salt))
    rows = []
    for f in range(k):
        train = folded.filter(F.col("__fold") != f).drop("__fold")
        test = folded.filter(F.col("__fold") == f).drop("__fold")
        t0 = time.time()
        predicted = fit_predict(train, test)
        t1 = time.time()
        err = F.col(prediction) - F.col(label)
        m = predicted.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae")).collect()[0]
        t2 = time.time()
        rows.append((f, float(m["rmse"]), float(m["mae"]), t1 - t0, t2 - t1))
    return spark.createDataFrame(rows, "fold int, rmse double, mae double, fit_time double, test_time double")
