"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``sample_rows``); every vector is then
placed in a leaf by descending to the nearest centre. A query walks the tree
best bin first: a priority queue holds the branches passed by, ordered by their
centres' distance, and leaves are visited in that order. The number of visits is
widened until the recall of calibration queries, measured against brute force
over all vectors, reaches ``recall``: of queries as they come, and of distinct
vectors, so copies don't speak for the rest. A query whose leaves hold fewer
than ``k`` rows of other ids goes on until they do or no leaf is left.

Search is a join of visited (query, leaf) pairs with the leaves' vectors. A
leaf is dealt into blocks of about ``BLOCK`` vectors, so a leaf that holds a
third of all rows is many groups; equal vectors of a block are scored once, and
each block returns its best ``k`` for a query, ties to the smaller id.
Scores are inner products in double precision, added up in a fixed order.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Repeated ids are separate candidates, but
no row with the query's own id answers it. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import written

BLOCK = 4096
SLACK = 1e-9


class Tree:
    """Nested k-means over a sample. ``nodes`` lists (centres, children); a negative child is leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, branch: int, leaf_rows: int, seed: int = 11):
        self.rng, self.nodes, self.leaves = np.random.default_rng(seed), [], 0
        self.branch, self.leaf_rows = branch, leaf_rows
        self.root = self.split(sample)

    def split(self, x: np.ndarray) -> int:
        if len(x) > self.leaf_rows:
            centres, owner = self.means(x)
            if len(centres) > 1:
                me = len(self.nodes)
                self.nodes.append(None)
                self.nodes[me] = (centres, [self.split(x[owner == c]) for c in range(len(centres))])
                return me
        self.leaves += 1
        return -self.leaves

    def means(self, x: np.ndarray, rounds: int = 8):
        centres = np.unique(x[self.rng.choice(len(x), min(self.branch, len(x)), replace=False)], axis=0)
        for _ in range(rounds):
            owner = (x @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
            keep = np.unique(owner)
            centres = np.stack([x[owner == c].mean(0) for c in keep])
        owner = (x @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
        keep, owner = np.unique(owner, return_inverse=True)
        return centres[keep], owner

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector."""
        out = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            centres, children = self.nodes[node]
            owner = (x[rows] @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
            stack += [(child, rows[owner == c]) for c, child in enumerate(children) if (owner == c).any()]
        return out

    def visit(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and as many more as it takes to hold ``rows`` by their ``sizes``."""
        found, heap = [], [(0.0, 0, self.root)]
        serial, held = 0, 0
        while heap and (len(found) < most or held < rows):
            _, _, node = heapq.heappop(heap)
            while node >= 0:
                centres, children = self.nodes[node]
                far = ((centres - q) ** 2).sum(1)
                near = int(far.argmin())
                for c, child in enumerate(children):
                    if c != near:
                        serial += 1
                        heapq.heappush(heap, (float(far[c]), serial, child))
                node = children[near]
            found.append(-1 - node)
            held += 0 if sizes is None else int(sizes[-1 - node])
        return found


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that take part, of the commonest length."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) \
        & F.exists("v", lambda x: x != 0)
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & fine)
    sizes = out.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return out.filter(F.size("v") == (sizes["d"] if sizes else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def best(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Exact top ``k`` of one block for every query: arrays query, id, score."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    distinct, back = np.unique(x, axis=0, return_inverse=True)
    back = back.ravel()
    by = np.argsort(back, kind="stable")
    cut = np.searchsorted(back[by], np.arange(len(distinct) + 1))
    out = ([], [], [])
    for lo in range(0, len(q), 256):
        rough = q[lo:lo + 256] @ distinct.T
        for r in range(len(rough)):
            s = rough[r]
            need = min(k + 1, len(s))
            near = np.flatnonzero(s >= np.partition(s, len(s) - need)[len(s) - need] - SLACK)
            exact = (distinct[near] * q[lo + r]).sum(axis=1)
            member = np.concatenate([by[cut[d]:min(cut[d + 1], cut[d] + k + 1)] for d in near])
            score = np.repeat(exact, [min(cut[d + 1] - cut[d], k + 1) for d in near])
            other = ids[member] != q_id[lo + r]
            member, score = member[other], score[other]
            top = np.lexsort((ids[member], -score))[:k]
            out[0].append(np.full(len(top), q_id[lo + r])), out[1].append(ids[member[top]]), out[2].append(score[top])
    return [np.concatenate(z) if z else np.zeros(0) for z in out]


FOUND = "query_id long, vec_id long, score double"


def found_batch(query, ids, score):
    return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(score.astype(float))],
                                      names=["query_id", "vec_id", "score"])


def brute_force(queries: np.ndarray, q_id: np.ndarray, rows: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of a bounded set of queries over all rows (id, v), block by block."""
    sent = rows.sparkSession.sparkContext.broadcast((q_id, queries))

    def task(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                yield found_batch(*best(*sent.value, part.column(0).to_numpy(), matrix(part.column(1)), k))
    return nearest(rows.mapInArrow(task, FOUND), k)


def nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.97, sample_rows: int = 8192, branch: int = 8,
           leaf_rows: int = 64, calibration_queries: int = 48, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query(id)`` holds.

    Tree and visits come from bounded samples, chosen by id: at most about
    ``sample_rows`` vectors and ``calibration_queries`` queries. Every usable
    vector is indexed.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chance = F.pmod(F.xxhash64(F.lit("tree"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(chance <= min(1.0, sample_rows / n)).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(matrix(sample) if len(sample) else np.zeros((1, 1)), branch, leaf_rows)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = sent.value.place(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])
    indexed = written(rows.mapInArrow(place, "id long, v array<double>, leaf long"), "indexed")
    queries = rows.filter(is_query(F.col("id")))
    visits = calibrated_visits(queries, indexed, tree, k, recall, calibration_queries)
    blocks = written(indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    sizes = np.zeros(tree.leaves, np.int64)   # as many leaves as the sample gave
    for leaf, size in blocks.select("leaf", "n").collect():
        sizes[leaf] = size
    # rows with the query's own id are no candidates
    own = queries.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    queries = queries.join(own, "id").select("id", "v", "own")

    def walk(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            leaves = [sent.value.visit(q, visits, sizes, k + own) for q, own in zip(x, batch.column(2).to_pylist())]
            row = np.repeat(np.arange(len(x)), [len(z) for z in leaves])
            flat = np.array([z for y in leaves for z in y], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(flat)],
                                             names=["id", "v", "leaf"])
    asked = queries.mapInArrow(walk, "id long, v array<double>, leaf long")
    blocks = blocks.select("leaf", "blocks")
    held = indexed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .select("leaf", "block", F.lit(False).alias("asks"), "id", "v")
    asking = asked.join(blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("leaf", "block", F.lit(True).alias("asks"), "id", "v")
    dealt = held.unionByName(asking).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "asks")

    def scored(batches):
        at, ids, x, q_id, q = None, [], [], [], []

        def done():
            if q and x:
                yield found_batch(*best(np.concatenate(q_id), np.concatenate(q), np.concatenate(ids), np.concatenate(x), k))
        for batch in batches:
            leaf, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            asks = np.asarray(batch.column(2))
            own, vec = batch.column(3).to_numpy(), matrix(batch.column(4))
            cut = np.flatnonzero((np.diff(leaf, prepend=leaf[:1]) != 0) | (np.diff(block, prepend=block[:1]) != 0))
            for lo, hi in zip([0, *cut], [*cut, len(leaf)]):
                if lo == hi:
                    continue
                if at != (leaf[lo], block[lo]):
                    yield from done()
                    at, ids, x, q_id, q = (leaf[lo], block[lo]), [], [], [], []
                a = asks[lo:hi]
                ids.append(own[lo:hi][~a]), x.append(vec[lo:hi][~a])
                if a.any():
                    q_id.append(own[lo:hi][a]), q.append(vec[lo:hi][a])
                if sum(map(len, q_id)) >= BLOCK:   # answer a crowd of queries in shares
                    yield from done()
                    q_id, q = [], []
        yield from done()
    return nearest(dealt.mapInArrow(scored, FOUND), k)


def calibrated_visits(queries: DataFrame, indexed: DataFrame, tree: Tree, k: int, recall: float, how_many: int) -> int:
    """The fewest leaves to visit at which the recall of calibration queries reaches ``recall``, both of
    ``how_many`` queries as they come and of ``how_many`` with distinct vectors."""
    distinct = queries.groupBy(F.xxhash64("v").alias("h")).agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")).select("id", "v")
    return max(visits_of(some, indexed, tree, k, recall, how_many) for some in (queries, distinct))


def visits_of(queries: DataFrame, indexed: DataFrame, tree: Tree, k: int, recall: float, how_many: int) -> int:
    n = queries.count()
    order = F.xxhash64(F.lit("ask"), "id")
    some = queries.filter(F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20)) <= min(1.0, 4 * how_many / max(n, 1))) \
        .orderBy(order, "id").limit(how_many).toArrow()
    if not some.num_rows:
        return 1
    q_id, q = some.column("id").to_numpy(), matrix(some.column("v").combine_chunks())
    truth = written(brute_force(q, q_id, indexed.select("id", "v"), k), "truth")
    where = truth.join(indexed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    rank = []
    for i, v in zip(q_id, q):
        place = {leaf: r + 1 for r, leaf in enumerate(tree.visit(v, tree.leaves))}
        rank += [place[x] for x in where["leaf"][where["query_id"] == i]]
    rank = np.sort(rank)
    return int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) if len(rank) else 1
