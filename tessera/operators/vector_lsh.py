"""Euclidean similarity join of real vectors by random projections with split buckets.

As in bucketed random projection a vector's hash in a table is the tuple of
floor((v . r + b) / length) of some projections r. Here the number of
projections follows the data: a table starts with ``START`` of them, and buckets
with more than ``HOT`` vectors are split by further ones until they are small or
the projections end. Splitting costs recall, so a vector also enters the buckets
next to it: on the weakest coordinates, those nearest a border, the neighbouring
cell is probed. Candidates are pairs of a bucket's own vectors and of own and
probing ones; their distances are computed from the vectors at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import euclidean
from tessera.operators.blocked import matrix
from tessera.session import ensure_checkpoint_dir

HOT = 64        # own vectors of a bucket that are paired as they are
START, STEP, MOST = 4, 4, 20     # projections of a table: at first, more per split, at most
PROBES = 3      # neighbouring cells probed at first
SPLIT_PROBES = 2     # and at each split


def hashed(vectors: DataFrame, width: int, bucket_length: float, tables: int, seed: int) -> DataFrame:
    """``(key, table, cells, steps, order)`` of ``(key, vec)``: cells of all ``MOST`` projections of a table, the step to the
    nearest neighbouring cell of each (-1 or 1), and the projections' numbers, those nearest a border first."""
    rng = np.random.default_rng(seed)
    directions, offsets = rng.normal(size=(width, tables * MOST)), rng.uniform(0, bucket_length, tables * MOST)
    kind = dict(vectors.dtypes)["key"]

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            at = ((matrix(batch.column(1)) @ directions + offsets) / bucket_length).reshape(n * tables, MOST)
            cells = np.floor(at)
            part = at - cells
            step = np.where(part < 0.5, -1, 1)
            order = np.argsort(np.minimum(part, 1 - part), axis=1, kind="stable")
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), t), MOST).cast(pa.list_(t))
                     for x, t in ((cells.astype(np.int64), pa.int64()), (step.astype(np.int32), pa.int32()), (order.astype(np.int32), pa.int32()))]
            row = pa.array(np.repeat(np.arange(n), tables))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), *lists],
                                             names=["key", "table", "cells", "steps", "order"])
    return vectors.select("key", "vec").mapInArrow(task, f"key {kind}, table int, cells array<long>, steps array<int>, order array<int>")


def bucket_members(entries: DataFrame) -> DataFrame:
    """``(bucket, key, own)`` of all final buckets, from :func:`hashed`."""
    def probed(lo: int, hi: int, many: int):
        """Cells with the neighbour's number in one of the ``many`` weakest projections from ``lo`` to ``hi``."""
        weak = F.slice(F.filter("order", lambda j: (j >= lo) & (j < hi)), 1, many)
        return F.transform(weak, lambda w: F.transform("cells", lambda c, j: F.when(j == w, c + F.col("steps")[w]).otherwise(c)))

    def widened(rows: DataFrame, lo: int, hi: int, many: int) -> DataFrame:
        own = F.array(F.struct(F.col("cells").alias("cells"), F.col("own").alias("own")))
        near = F.when(F.col("own"), F.transform(probed(lo, hi, many), lambda c: F.struct(c.alias("cells"), F.lit(False).alias("own"))))
        every = F.concat(own, F.coalesce(near, F.slice(own, 1, 0)))
        return (rows.withColumn("x", F.explode(every)).select("key", "table", F.col("x.cells").alias("cells"), "steps", "order", F.col("x.own").alias("own"))
                .withColumn("bucket", F.xxhash64("table", F.lit(hi), F.slice("cells", 1, hi))))
    open_, done, depth = widened(entries.withColumn("own", F.lit(True)), 0, START, PROBES), None, START
    while True:
        sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("own").cast("int")).alias("n")) \
            .filter("c > 1 and n > 0").checkpoint()
        joined = open_.join(sizes, "bucket")
        small = joined if depth >= MOST else joined.filter(F.col("n") <= HOT)
        done = small.select("bucket", "key", "own") if done is None else done.unionByName(small.select("bucket", "key", "own"))
        if depth >= MOST or sizes.filter(F.col("n") > HOT).isEmpty():
            return done
        hot = joined.filter(F.col("n") > HOT).select("key", "table", "cells", "steps", "order", "own")
        open_ = widened(hot, depth, depth + STEP, SPLIT_PROBES).checkpoint()
        depth += STEP


def vector_pairs(vectors: DataFrame, key: str, max_distance: float, bucket_length: float, vec: str = "vec", tables: int = 8,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(pairs, classes)``: pairs ``(a, b, dist)``, a < b, of different vectors within ``max_distance`` (exact distances,
    approximate recall), between class representatives; ``classes`` is ``(key, rep)`` for every usable row, rows of equal
    vectors having one representative, their least key.

    Rows with a null key or vector, a null or non-finite component, or another length than most take no part. Copies are
    folded before anything is hashed, so a vector that a third of all rows hold is one entry.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # + 0.0 makes the two zeros one
    rows = vectors.select(F.col(key).alias("key"), F.transform(F.col(vec), lambda x: x.cast("double") + F.lit(0.0)).alias("vec")) \
        .filter("key is not null and vec is not null").filter(fine)
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    width = common["d"] if common else 1
    rows = rows.filter(F.size("vec") == width)
    reps = rows.groupBy("vec").agg(F.min("key").alias("rep")).checkpoint()
    classes = rows.join(reps, "vec").select("key", "rep")
    own = reps.select(F.col("rep").alias("key"), "vec")
    members = bucket_members(hashed(own, width, bucket_length, tables, seed).checkpoint()).checkpoint()
    x, y = members.alias("x"), members.filter("own").alias("y")
    pairs = (x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") != F.col("y.key")))
             .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())
    va, vb = own.select(F.col("key").alias("a"), F.col("vec").alias("va")), own.select(F.col("key").alias("b"), F.col("vec").alias("vb"))
    found = pairs.join(va, "a").join(vb, "b").select("a", "b", euclidean("va", "vb").alias("dist"))
    return found.filter(F.col("dist") <= max_distance), classes
