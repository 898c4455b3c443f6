"""Hard negatives by cover trees over norm-augmented vectors.

Every vector x becomes (x, sqrt(M^2 - |x|^2)), so all stand on a sphere of
radius M and a query's inner product with x is |q| M times a cosine. A cover
tree halves its covering radius from level to level; a node's radius bounds the
angle between its centre and all below it, hence the inner products of a query
with them, from both sides. A search goes down best bound first, skips nodes
whose bounds lie outside the window asked for, ends when no node can beat the
``top`` found, and checks leaves exactly, in whole numbers.

The first level is shared: up to ``REGIONS`` centres from a bounded sample.
Every row goes to its nearest centre's region; a region above ``BLOCK`` rows,
such as one of copies, is dealt into blocks by id. An anchor is sent only to
regions whose covering radius allows a hit; in a search for positives the floor
is its ``top``-th best row of its label in a small sample. A task holds one block
and a share of the anchors; answers of blocks are merged ``top`` at a time.

Vectors become floor(256 * component). Scores are whole numbers; where a double
might not hold them exactly, Python's integers do the sum. A score outside a
long counts as its nearest end.

Nulls, ties, repeats: rows with a null id, label, vector or component, with a
non-finite component (also after the factor 256), or of another length than
most take no part. Of the rows of one id the one with the least label and
vector takes part. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.neighbours import matrix
from tessera.llm.shared import forget, written

BLOCK = 4096          # rows of a block, on average
REGIONS = 256
SAMPLE = 4096         # rows that the regions' centres are taken from
FLOOR_ROWS = 1024     # rows that give the floor of a search for positives
LEAF = 32
LOW, HIGH = 80, 100   # a negative's score lies within these percents of the positive's
MOST = (1 << 63) - 1
NO_FLOOR = -(1 << 63)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors, by Python's integers where a double may not hold them."""
    if not x.size or x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) < 2 ** 53:
        return (x @ q).astype(np.int64)
    whole = [int(z) for z in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), -MOST), MOST) for row in x], np.int64)


def first(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` highest scores with their ids, ties to the smaller id."""
    if len(scores) > 64:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = scores >= least
        scores, ids = scores[near], ids[near]
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(-scores[order], kind="stable")][:top]
    return scores[order], ids[order]


class Sphere:
    """Bounds of inner products from angles on the sphere of augmented vectors."""

    def __init__(self, most: float):
        self.radius = max(most, 1.0)
        self.sound = self.radius < 1e100     # beyond, squares may overflow: nothing is skipped

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of the augmented rows."""
        if not self.sound:
            return np.zeros((len(x), x.shape[1] + 1))
        rest = np.sqrt(np.maximum(self.radius ** 2 - (x ** 2).sum(axis=1), 0))
        return np.column_stack([x, rest]) / self.radius

    def bounds(self, centres: np.ndarray, angles: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product of ``q`` with any vector within ``angles`` of the lifted ``centres``."""
        size = np.sqrt((q ** 2).sum()) if self.sound else np.inf
        if not self.sound or not size < 1e100:
            return np.full(len(centres), -np.inf), np.full(len(centres), np.inf)
        if not size:
            return np.zeros(len(centres)), np.zeros(len(centres))
        to = np.arccos(np.clip(centres[:, :-1] @ q / size, -1, 1))
        scale, slack = size * self.radius, 1e-6 * size * self.radius
        return (np.where(to + angles >= np.pi, -scale, np.cos(np.minimum(to + angles, np.pi)) * scale) - slack,
                np.cos(np.maximum(to - angles, 0)) * scale + slack)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors, a row each or one for all."""
    return np.arccos(np.clip((a * b).sum(axis=-1), -1, 1))


def cover(points: np.ndarray, reach: float, least: int) -> tuple[list[int], np.ndarray]:
    """Centres more than ``reach`` apart that cover the points: (points chosen, centre of each point or -1).

    Centres that cover fewer than ``least`` points are none; where many in a row do, the rest stays uncovered.
    """
    owner, open_, centres, thin = np.full(len(points), -1), np.arange(len(points)), [], 0
    while len(open_) and thin < 48:
        c = open_[0]
        near = np.clip(points[open_] @ points[c], -1, 1) >= np.cos(reach)
        near[0] = True
        if near.sum() >= least:
            owner[open_[near]] = len(centres)
            centres.append(int(c))
            thin = 0
        else:
            thin += 1
        open_ = open_[~near]
    return centres, owner


class CoverTree:
    """A cover tree over one block; a node is (centre, angle, children or rows)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.sphere = Sphere(float(np.sqrt((x ** 2).sum(axis=1).max(initial=0))) if np.abs(x).max(initial=0) < 1e100 else np.inf)
        lifted = self.sphere.lift(self.x)
        self.centres, self.angles, self.below = [], [], []
        self.grow(lifted, np.arange(len(x)), 0)
        self.centres, self.angles = np.array(self.centres), np.array(self.angles)

    def grow(self, lifted: np.ndarray, rows: np.ndarray, centre: int) -> int:
        me, wide = len(self.centres), angle(lifted[rows], lifted[centre]).max(initial=0)
        self.centres.append(lifted[centre]), self.angles.append(wide), self.below.append((True, rows))
        if len(rows) <= LEAF or wide < 1e-6:
            return me
        centres, owner = cover(lifted[rows], wide / 2, LEAF // 4)
        if centres:
            children = [self.grow(lifted, rows[owner == i], rows[c]) for i, c in enumerate(centres)]
            rest = rows[owner < 0]
            if len(rest):      # rows too far apart to share a smaller radius: a leaf with this node's
                children.append(len(self.centres))
                self.centres.append(lifted[centre]), self.angles.append(angle(lifted[rest], lifted[centre]).max()), self.below.append((True, rest))
            self.below[me] = (False, children)
        return me

    def search(self, q: np.ndarray, low, high, wanted, top: int, scores: dict) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` best (scores, ids) from ``low`` to ``high`` of rows for which ``wanted`` (a mask) holds.

        ``scores`` keeps the leaves' exact scores for the query's next windows.
        """
        if "bounds" not in scores:
            scores["bounds"] = self.sphere.bounds(self.centres, self.angles, q)
        least, most = scores["bounds"]
        best, ids, heap = np.zeros(0, np.int64), np.zeros(0, np.int64), [(-most[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) == top and -bound < best[-1]:
                break
            if -bound < low or least[node] > high:
                continue
            leaf, below = self.below[node]
            if not leaf:
                for child in below:
                    heapq.heappush(heap, (-min(most[child], -bound), child))
                continue
            if node not in scores:
                scores[node] = exact_scores(self.x[below], q)
            s = scores[node]
            fits = wanted[below] & (s >= low) & (s <= high)
            if fits.any():
                best, ids = first(np.concatenate([best, s[fits]]), np.concatenate([ids, self.ids[below][fits]]), top)
        return best, ids


def quantised(rows: DataFrame, id_col: str, vec_col: str, label_col: str, relabel) -> DataFrame:
    """(id, label, v): the rows that take part, one an id."""
    raw = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double") * F.lit(256.0))
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(raw, lambda x: F.when(F.abs(x) < F.lit(2.0 ** 52), F.floor(x).cast("double")).otherwise(x))   # above, a double is whole
    some = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       F.when(fine, whole).alias("v")).filter("id is not null and label is not null and v is not null")
    one = some.withColumn("label", relabel(F.col("id"), F.col("label"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("id", "row.label", "row.v")


def small_sample(rows: DataFrame, n: int, most: int, salt: str):
    """At most about ``most`` rows, chosen by id: arrays id, label, v."""
    chance = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = rows.filter(chance < min(1.0, most / max(n, 1))).orderBy("id").toArrow()
    x = matrix(got.column("v").combine_chunks()) if got.num_rows else np.zeros((0, 0))
    return got.column("id").to_numpy(), got.column("label").to_numpy(), x


class Regions:
    """The shared first level: lifted centres and, once rows are placed, covering angles."""

    def __init__(self, sample: np.ndarray, sphere: Sphere, many: int):
        self.sphere = sphere
        lifted = sphere.lift(sample)
        chosen, far = [0], angle(lifted, lifted[0])
        while len(chosen) < min(many, len(lifted)) and far.max() > 1e-6:      # farthest first
            chosen.append(int(far.argmax()))
            far = np.minimum(far, angle(lifted, lifted[chosen[-1]]))
        self.centres = lifted[chosen]
        self.angles = np.full(len(chosen), np.pi)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lifted = self.sphere.lift(x)
        near = (lifted @ self.centres.T).argmax(axis=1)
        return near, angle(lifted, self.centres[near])


FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def answers(tree: CoverTree, q_id: int, label: int, q: np.ndarray, near: list[int], top: int):
    """Rows of FOUND from one block: of a search for positives (``near``: its floor) or of each positive's window."""
    other, scores = tree.ids != q_id, {}
    if len(near) == 1:
        floor = -np.inf if near[0] == NO_FLOOR else near[0]
        found = tree.search(q, floor, np.inf, other & (tree.labels == label), top, scores)
        return [(q_id, None, None, int(i), int(s)) for s, i in zip(*found)]
    out, wanted = [], other & (tree.labels != label)
    for p_id, p in zip(near[::2], near[1::2]):
        low = -(-LOW * p // 100)
        if low <= p:
            found = tree.search(q, low, p, wanted, top, scores)
            out += [(q_id, p_id, p, int(i), int(s)) for s, i in zip(*found)]
    return out


def searched(placed: DataFrame, asking: DataFrame, top: int) -> DataFrame:
    """Answers of every block to the anchors sent to it (FOUND)."""
    held = placed.select("region", "block", F.lit(False).alias("asks"), "id", "label", "v", F.lit(None).cast("array<long>").alias("near"))
    dealt = held.unionByName(asking).repartition("region", "block").sortWithinPartitions("region", "block", "asks")

    def task(batches):
        at, held, tree = None, [], None
        for batch in batches:
            region, block, asks, ids, labels = (np.asarray(c) for c in batch.columns[:5])
            x, near = (matrix(batch.column(5)) if batch.num_rows else None), batch.column(6)
            cut = np.flatnonzero((np.diff(region) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
                if lo == hi:
                    continue
                if at != (region[lo], block[lo]):
                    at, held, tree = (region[lo], block[lo]), [], None
                if not asks[lo]:
                    held.append((ids[lo:hi], labels[lo:hi], x[lo:hi]))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = CoverTree(*map(np.concatenate, zip(*held)))
                for some in range(lo, hi, 512):
                    out = [r for i in range(some, min(some + 512, hi)) for r in answers(tree, int(ids[i]), labels[i], x[i], near[i].as_py(), top)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                         names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])
    return dealt.mapInArrow(task, FOUND)


def ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine(vectors: DataFrame, is_anchor, top: int = 5, relabel=lambda i, label: label, id_col: str = "vec_id",
         vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, the rows for whose
    id ``is_anchor`` holds: for each of its ``top`` nearest rows of its label, the first ``top`` rows of other labels
    whose score is 80 to 100 % of the positive's."""
    spark = vectors.sparkSession
    usable = written(quantised(vectors, id_col, vec_col, label_col, relabel), "vectors")
    size = usable.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("most")) \
        .orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, n = usable.filter(F.size("v") == size["d"]), size["n"]
    sphere = Sphere(size["most"])
    sample = small_sample(rows, n, SAMPLE, "regions")[2]
    regions = Regions(sample if len(sample) else np.zeros((1, size["d"])), sphere, min(REGIONS, -(-n // BLOCK)))
    sent = spark.sparkContext.broadcast(regions)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                region, far = sent.value.place(matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far)], names=["id", "label", "v", "region", "far"])
    placed = written(rows.mapInArrow(place, "id long, label long, v array<double>, region long, far double"), "placed")
    parts = np.zeros(len(regions.centres), np.int64)
    angles = np.zeros(len(parts))
    for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():   # at most REGIONS rows
        parts[r["region"]], angles[r["region"]] = -(-r["n"] // BLOCK), r["far"]
    regions.angles = angles + 1e-6
    wide = spark.sparkContext.broadcast((regions, parts))
    blocks = F.element_at(F.array(*[F.lit(max(1, int(p))) for p in parts]), (F.col("region") + 1).cast("int"))
    placed_blocks = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    floor = spark.sparkContext.broadcast(small_sample(rows, n, FLOOR_ROWS, "floor"))
    forget(usable)
    anchors = placed.filter(is_anchor(F.col("id"))).select("id", "label", "v")

    def asking(known: bool):
        """Anchors, a row for each block that may answer: with the floor of their positives or, if known, the positives."""
        def task(batches):
            regions, parts = wide.value
            ids, labels, x = floor.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, region, near = [], [], []
                own, kind, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
                told = batch.column(3).to_pylist() if known else None
                for i, q in enumerate(vectors):
                    least, most = regions.sphere.bounds(regions.centres, regions.angles, q)
                    if known:
                        now = [z for p in told[i] for z in (p["found_id"], p["score"])]
                        ask = (most >= min(LOW * p / 100 for p in now[1::2])) & (least <= max(now[1::2]))
                    else:
                        same = np.flatnonzero((labels == kind[i]) & (ids != own[i]))
                        now = [int(first(exact_scores(x[same], q), ids[same], top)[0][-1]) if len(same) >= top else NO_FLOOR]
                        ask = (most >= now[0]) | (now[0] == NO_FLOOR)
                    for r in np.flatnonzero(ask & (parts > 0)):
                        row.append(i), region.append(r), near.append(now)
                at = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(region, np.int64)), *(batch.column(c).take(at) for c in range(3)),
                                                  pa.array(near, pa.list_(pa.int64()))], names=["region", "id", "label", "v", "near"])
        return task

    def sent_out(asked: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))
        return asked.select("region", every.alias("block"), F.lit(True).alias("asks"), "id", "label", "v", "near")
    to_regions = "region long, id long, label long, v array<double>, near array<long>"
    first_asked = sent_out(anchors.mapInArrow(asking(False), to_regions))
    positives = written(ranked(searched(placed_blocks, first_asked, top), ["anchor_id"], top).select("anchor_id", "found_id", "score"), "positives")
    lists = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("found_id", "score")).alias("known"))
    knowing = anchors.join(lists, anchors["id"] == lists["anchor_id"]).select("id", "label", "v", "known")
    negatives = searched(placed_blocks, sent_out(knowing.mapInArrow(asking(True), to_regions)), top)
    return ranked(negatives, ["anchor_id", "positive_id"], top).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
