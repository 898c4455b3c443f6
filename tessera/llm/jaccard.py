"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

Each text is its set of distinct k-word shingles; two texts link when
``100 * |A and B| >= percent * |A or B|``. The join never lists the pairs of a
group:

1. *Classes.* Texts with the same set (128-bit fingerprint) are one node, the
   smallest id among them, so exact copies cost one row from here on.
2. *Tiles.* Shingles have one global order, longest first (long shingles are
   rare). Linked sets share one of their first ``n - ceil(t n) + 1`` shingles,
   so a tile is (shared prefix shingle, size band); a set enters its own band
   and those its larger partners can lie in. Tiles of more than ``crowd`` sets
   (a passage that many texts hold) are replaced by tiles of equal slices: a
   band's hash range is cut into more slices than two linked sets of the band
   can differ in, so at least one slice is equal.
3. *Bitmaps.* Every set has a hashed bitmap. A bit set in A's only proves an
   element outside B, so ``|A| - bits(A & ~B)`` bounds the overlap from above.
4. *Exact step.* Pairs that pass the bound meet their sorted shingle arrays.

Pairs are tried first against two hubs of each tile (linear in the rows) and
the links become components; tiles of the same sets count once. Only tiles
whose other sets still lie in different components compare them, block against
block, in numpy. What leaves a task is first a forest of the likeliest links
between components (fewer pairs than rows) and the rows of the other pairs that
pass. After the forest's exact step these rows meet again with bitmaps of
``WIDE`` times their size, and the pairs that pass this bound too and would
still join two components go to the exact step.

Nulls and ties: a null or empty text, or one without words, has no shingles
and is linked with nothing; its component is itself. A repeated row joins its
class. A null id gets its class's component. Columns other than the id and the
text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.idfilter import id_filter, passes
from tessera.llm.shared import forget, forget_since, live, written
from tessera.llm.textarrays import (NOT_SPACE, byte_table, chunks, hash_runs, mix, ragged, release, runs,
                                    shingle_hashes)

GROWTH = 1.25          # ratio of the sizes a band spans
LEAST_BITS, MOST_BITS = 128, 8192
WIDE, MOST_WIDE_BITS = 16, 1 << 16   # of the second comparison
SALTS = 64
BLOCK_ROWS = 1024


def reach(n, percent: int):
    """The largest size a set of size ``n`` can link with."""
    return n * 100 // percent


def prefix_length(n, percent: int):
    """First shingles of a set of ``n`` of which linked sets share one."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def band_edges(limit: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return np.array(edges, np.int64)


def slices_of(band: int, edges: np.ndarray, percent: int) -> int:
    """Slices of a band: more than two linked sets of it can differ in, and some to spare for empty ones."""
    top = int(edges[band + 1]) - 1
    differ = 2 * top * (100 - percent) // (100 + percent)
    return differ + 2 + differ // 8


def bitmap_width(n: np.ndarray, times: int = 2, most: int = MOST_BITS) -> np.ndarray:
    """Bits of a set's bitmap: the power of two from ``times`` its size on, within limits."""
    w = 1 << np.ceil(np.log2(np.maximum(times * n, 1))).astype(np.int64)
    return np.clip(w, LEAST_BITS, most)


def shingle_sets(column, k: int, with_length: bool = False):
    """Yield (row, sorted distinct shingle hashes, byte length of each or None) for every text."""
    values = byte_table(fold_case=True)
    row = 0
    for i, j, buf, off in chunks(column):
        s, e, doc = runs(buf, off, NOT_SPACE)
        words = hash_runs(buf, s, e, values)
        h, owner = shingle_hashes(words, doc, j - i, k)
        if with_length:
            total = np.concatenate([[0], np.cumsum(e - s)])
            count = np.bincount(doc, minlength=j - i)
            first = np.cumsum(count) - count
            per = np.bincount(owner, minlength=j - i)
            at = ragged(first, per)
            size = total[np.minimum(at + k, (first + count)[owner])] - total[at]
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        for d in range(j - i):
            a, b = cut[d], cut[d + 1]
            u, where = np.unique(h[a:b], return_index=True)
            yield i + d, u, (size[a:b][where] if with_length else None)
        row = j


def bitmap(u: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


FEATURES = "id long, n long, print binary, bits binary, prefix array<long>"


def features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Size, fingerprint, bitmap and prefix shingles of every text."""
    def task(batches):
        for batch in batches:
            ids = batch.column(0)
            n, fp, bits, prefix = [], [], [], []
            for _, u, size in shingle_sets(batch.column(1), k, with_length=True):
                n.append(len(u))
                if not len(u):
                    fp.append(None), bits.append(None), prefix.append([])
                    continue
                m = mix(u + np.uint64(0x1234567))
                fp.append(np.array([m.sum(dtype=np.uint64), mix(m ^ np.uint64(77)).sum(dtype=np.uint64)]).tobytes())
                bits.append(bitmap(u, int(bitmap_width(np.array(len(u))))))
                p = int(prefix_length(np.array(len(u)), percent))
                # a set that can link with no other set than an equal one needs no tile
                alone = reach(len(u), percent) == len(u) and (len(u) - 1) * 100 < percent * len(u)
                order = np.lexsort((u, -size))[:0 if alone else p]
                prefix.append(u[order].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bits, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64()))], names=["id", "n", "print", "bits", "prefix"])
        release()
    return docs.mapInArrow(task, FEATURES)


def overlap_bound(na, nb, only_a, only_b):
    """Upper bound of the overlap from the bits only one side has."""
    return np.minimum(na - only_a, nb - only_b)


def may_link(na, nb, bound, percent: int):
    """Whether an overlap of ``bound`` would link sets of these sizes."""
    return 100 * bound >= percent * (na + nb - bound)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of a width folded to a smaller one."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def prune(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, id) whose bit counts allow a link."""
    a = sets.select(F.col("id").alias("hub"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = sets.select("id", F.col("n").alias("nb"), F.col("bits").alias("bb"))
    sized = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = pairs.join(b, "id").join(a, "hub").filter(sized).select("hub", "id", "na", "nb", "ba", "bb")

    def task(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                w = min(len(x), len(y))
                x, y = fold(x, w), fold(y, w)
                only = (int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()))
                keep[i] = may_link(na[i], nb[i], overlap_bound(na[i], nb[i], *only), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["hub", "id"]).filter(pa.array(keep))
    return both.mapInArrow(task, "hub long, id long")


def shingle_arrays(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Sorted shingle arrays of the texts whose id is in ``ids`` (and few others)."""
    chosen = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def task(batches):
        for batch in batches:
            part = batch.filter(passes(chosen.value, batch.column(0)))
            if part.num_rows:
                arrays = [u.view(np.int64) for _, u, _ in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(arrays, pa.list_(pa.int64()))],
                                                 names=["id", "shingles"])
        release()
    return docs.mapInArrow(task, "id long, shingles array<long>")


def wide_bitmaps(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, bits) with bitmaps of ``WIDE`` times the size of the texts whose id is in ``ids`` (and few others)."""
    chosen = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def task(batches):
        for batch in batches:
            part = batch.filter(passes(chosen.value, batch.column(0)))
            sets = [u for _, u, _ in shingle_sets(part.column(1), k)] if part.num_rows else []
            bits = [bitmap(u, int(bitmap_width(np.array(len(u)), WIDE, MOST_WIDE_BITS))) for u in sets]
            if sets:
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(u) for u in sets], pa.int64()),
                                                  pa.array(bits, pa.binary())], names=["id", "n", "bits"])
    return docs.mapInArrow(task, "id long, n long, bits binary").dropDuplicates()


def exact_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (hub, id) that link, by intersecting their sorted arrays (a written table).

    Only the arrays of the pairs' texts are made. A hub's array is sent once to
    each salted share of its partners; the rows of a share arrive sorted with
    the hub first, so a task holds one hub at a time.
    """
    arrays = written(shingle_arrays(texts, pairs.select("id").union(pairs.select("hub")), k), "arrays")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    hubs = salted.select("hub", "salt").distinct().join(arrays.withColumnRenamed("id", "hub"), "hub") \
        .select("hub", "salt", F.lit(None).cast("long").alias("id"), "shingles")
    others = salted.join(arrays, "id").select("hub", "salt", "id", "shingles")
    rows = hubs.unionByName(others).repartition("hub", "salt") \
        .sortWithinPartitions("hub", "salt", F.col("id").asc_nulls_first())

    def task(batches):
        at, own = None, []
        for batch in batches:
            hub, salt = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            id_, col = batch.column(2).to_pylist(), batch.column(3)
            off, flat = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
            out = ([], [])
            for r in range(batch.num_rows):
                mine = flat[off[r]:off[r + 1]]
                if id_[r] is None:
                    if at != (hub[r], salt[r]):
                        at, own = (hub[r], salt[r]), []
                    own.append(mine.copy())
                    continue
                for x in own if at == (hub[r], salt[r]) else []:
                    small, large = (x, mine) if len(x) < len(mine) else (mine, x)
                    p = np.searchsorted(large, small)
                    both = int((large[np.minimum(p, len(large) - 1)] == small).sum()) if len(small) else 0
                    if both and 100 * both >= percent * (len(x) + len(mine) - both):
                        out[0].append(hub[r]), out[1].append(id_[r])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["hub", "id"])
        release()
    links = written(rows.mapInArrow(task, "hub long, id long"), "links")
    forget(arrays)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable by links (hub, id), for every id in a link.

    Labels spread to neighbours and jump to their label's label each round, so
    rounds grow with the logarithm of a chain; each round is a written table.
    """
    edges = written(links.select("hub", "id").union(links.select(F.col("id").alias("hub"), F.col("hub").alias("id"))).distinct(),
                    "edges")
    labels = written(edges.groupBy("id").agg(F.least(F.min("hub"), F.col("id")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "hub"), "hub").groupBy("id").agg(F.min("label").alias("seen"))
        spread = written(labels.join(near, "id", "left").select(
            "id", "label", F.least("label", F.coalesce("seen", "label")).alias("next")), "spread")
        jump = spread.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        nxt = written(spread.join(jump, "next").select(
            "id", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("moved")), "labels")
        forget(labels, spread)
        labels = nxt
        if labels.filter("moved").isEmpty():
            forget(edges)
            return labels.select("id", "label")


def banded(members: DataFrame, percent: int) -> DataFrame:
    """Rows (key, id, n) dealt to tiles (key, band): a set's own band and those of larger partners."""
    edges = [int(x) for x in band_edges()]
    grid = F.array(*[F.lit(x) for x in edges])

    def band(size):
        return F.size(F.filter(grid, lambda x: x <= size)) - 1
    return members.withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.floor(F.col("n") * 100 / percent)))))


def slice_tiles(arrays: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(key, band, id, n) of the equal-slice tiles of the sets in ``ids``.

    Sets with more empty slices than their band has to spare also enter the
    tiles of empty slices; the others share a slice that isn't empty.
    """
    def task(batches):
        edges = band_edges()
        for batch in batches:
            col = batch.column(1)
            off, flat = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
            out = ([], [], [], [])
            for r, id_ in enumerate(batch.column(0).to_pylist()):
                u = flat[off[r]:off[r + 1]]
                low, high = np.searchsorted(edges, [len(u), reach(len(u), percent)], "right") - 1
                for b in range(low, high + 1):
                    m = slices_of(b, edges, percent)
                    top = int(edges[b + 1]) - 1
                    spare = m - 2 * top * (100 - percent) // (100 + percent)
                    place = (mix(u + np.uint64(5)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
                    order = np.argsort(place, kind="stable")
                    cut = np.searchsorted(place[order], np.arange(m + 1, dtype=np.uint64))
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(u[order] ^ np.uint64(0xC0FFEE)), dtype=np.uint64)])
                    key = mix((sums[cut[1:]] - sums[cut[:-1]]) + mix(np.arange(m, dtype=np.uint64) * np.uint64(31) + np.uint64(b)))
                    full = cut[1:] > cut[:-1]
                    if m - int(full.sum()) < spare:
                        key = key[full]
                    out[0].append(key.view(np.int64)), out[1].append(np.full(len(key), b))
                    out[2].append(np.full(len(key), id_)), out[3].append(np.full(len(key), len(u)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                                                 names=["key", "band", "id", "n"])
    return arrays.join(ids, "id", "left_semi").mapInArrow(task, "key long, band long, id long, n long")


def spanning(u, v, bound_j, of) -> np.ndarray:
    """Indices of the pairs (u, v) that a greedy forest over the components ``of`` takes, likeliest first."""
    root: dict = {}

    def top(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x
    take = []
    for i in np.argsort(-bound_j, kind="stable").tolist():
        a, b = top(of[u[i]]), top(of[v[i]])
        if a != b:
            root[a] = b
            take.append(i)
    return np.array(take, np.int64)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, band, c, id) of tiles of ``c`` sets dealt into blocks of about ``BLOCK_ROWS``; a pair
    of blocks (key, band, p, q) is one group, ``own`` the row's block."""
    blocks = F.ceil(F.col("c") / BLOCK_ROWS).cast("int")
    return (rows.withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")))


def block_survivors(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of one group in different components that pass the bit-count bound: (key, band, p, q, own, hub, id).

    With ``forest`` a group sends only pairs that, likeliest first, join its
    components into trees, fewer than it has rows, and after them the rows
    (hub null) of all other pairs that pass. Without, it sends all pairs.

    ``rows``: (key, band, p, q, own, id, n, label, bits).
    """
    dealt = rows.select("key", "band", "p", "q", "own", "id", "n", "label", "bits") \
        .repartition("key", "band", "p", "q").sortWithinPartitions("key", "band", "p", "q")

    def compare(group):
        """group: arrays own, id, n, label and bitmaps of one pair of blocks."""
        p, q, own, id_, n, label, raw = group
        words = min(len(x) for x in raw) // 8
        bits = np.stack([fold(np.frombuffer(x, np.uint64), words) for x in raw])
        left, right, found = np.flatnonzero(own == p), np.flatnonzero(own == q), []
        step = max(1, (1 << 21) // max(1, len(right) * words))
        for i in range(0, len(left), step):
            a = left[i:i + step]
            ok = (label[a][:, None] != label[right][None, :])
            if p == q:
                ok &= id_[a][:, None] < id_[right][None, :]
            na, nb = n[a][:, None], n[right][None, :]
            ok &= (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            if not ok.any():
                continue
            x, y = bits[a][:, None, :], bits[right][None, :, :]
            bound = overlap_bound(na, nb, np.bitwise_count(x & ~y).sum(-1, dtype=np.int64),
                                  np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
            r, c = np.nonzero(ok & may_link(na, nb, bound, percent))
            if forest:
                b = bound[r, c]
                found.append((a[r], right[c], b / (n[a[r]] + n[right[c]] - b)))
                continue
            u, v = id_[a[r]], id_[right[c]]
            yield np.minimum(u, v), np.maximum(u, v)
        if found:
            r, c, j = (np.concatenate(z) for z in zip(*found))
            take = spanning(r, c, j, label.tolist())
            u, v = id_[r[take]], id_[c[take]]
            yield np.minimum(u, v), np.maximum(u, v)
            again = np.unique(np.concatenate([np.delete(r, take), np.delete(c, take)]))
            yield None, again

    def task(batches):
        held, at = [], None

        def done():
            if len(held) > 1:
                own, id_, n, label = (np.array([h[i] for h in held]) for i in range(4))
                for u, v in compare((at[2], at[3], own, id_, n, label, [h[4] for h in held])):
                    rows = u is None   # v: which rows
                    of = [pa.array(own[v], pa.int32()), pa.nulls(len(v), pa.int64()), pa.array(id_[v])] if rows else \
                        [pa.nulls(len(v), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())]
                    group = [pa.array(np.full(len(v), x), t) for x, t in zip(at, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(group + of, names=["key", "band", "p", "q", "own", "hub", "id"])
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for key, band, p, q, own, id_, n, label, bits in zip(*cols):
                if at != (key, band, p, q):
                    yield from done()
                    held, at = [], (key, band, p, q)
                held.append((own, id_, n, label, bits))
        yield from done()
        release()
    return dealt.mapInArrow(task, "key long, band long, p int, q int, own int, hub long, id long")


def still_open(rows: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with their component's label, of groups that lie in several components."""
    named = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = named.groupBy(*group).agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select(*group)
    return named.join(written(several, "open"), group)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                 crowd: int = 4096) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, itself included.
    See the module's description for the method and for nulls and ties.
    """
    before = set(live)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wide = written(features(texts, k, percent), "shingles")
    classes = written(wide.filter("n > 0").groupBy("print").agg(F.min("id").alias("node")), "classes")
    nodes = wide.select("id", "n", "print", "bits").join(classes, "print")
    sets = written(nodes.filter("id = node").select("id", "n", "bits").dropDuplicates(["id", "n", "bits"]), "sets")
    rows = written(wide.select("id", "n", "print"), "rows")

    keys = wide.select("id", "n", F.explode("prefix").alias("key"))
    several = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "several")
    shared = keys.join(several, "key").select("key", "id", "n").join(sets.select("id"), "id", "left_semi").distinct()
    members = written(banded(shared, percent), "members")
    forget(wide)
    sizes = members.groupBy("key", "band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    sizes = written(sizes, "sizes")
    crowded = members.join(sizes.filter(F.col("c") > crowd).select("key", "band"), ["key", "band"], "left_semi").select("id").distinct()
    parts = [members.join(sizes.filter(F.col("c") <= crowd), ["key", "band"]).select("key", "band", "id", "n")]
    if not sizes.filter(F.col("c") > crowd).isEmpty():
        parts.append(slice_tiles(shingle_arrays(texts, crowded, k), crowded, percent))
    tiles = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    tiles = written(tiles, "tiles")

    # tiles of the same sets are one; xors of two hashes of the ids tell
    mark = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    hubs = (tiles.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("c"), F.min(mark)["id"].alias("low"), F.max(mark)["id"].alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("low <> high"))
    hubs = written(hubs.groupBy("c", "x", "y", "low", "high").agg(F.min(F.struct("key", "band")).alias("tile"))
                   .select("tile.key", "tile.band", "c", "low", "high"), "hubs")
    tiles_ = tiles.join(hubs, ["key", "band"])
    stars = tiles_.select(F.explode(F.array("low", "high")).alias("hub"), "id").filter("hub <> id")
    tried = written(prune(stars.distinct(), sets, percent), "stars")
    links = exact_links(tried, texts, k, percent)
    labels = components(links)

    # Tiles whose sets besides the hubs lie in several components: first a forest of the likeliest
    # links between their components, then the rows of the other pairs that passed meet with wide bitmaps.
    others = written(tiles_.filter("c > 3 and id <> low and id <> high").select("key", "band", "c", "id"), "others")
    forget(tiles, members)
    found = in_blocks(still_open(others, labels, ["key", "band"]).join(sets, "id"))
    found = written(block_survivors(found, percent, forest=True), "found")
    fresh = found.filter("hub is not null").select("hub", "id").distinct().join(tried, ["hub", "id"], "left_anti")
    fresh = written(fresh, "forest")
    if not fresh.isEmpty():
        links = links.unionByName(exact_links(fresh, texts, k, percent))
        tried = tried.unionByName(fresh)
        labels = components(links)
    again = found.filter("hub is null").select("key", "band", "p", "q", "own", "id")
    again = written(still_open(again, labels, ["key", "band", "p", "q"]), "again")
    if not again.isEmpty():
        wide = written(wide_bitmaps(texts, again.select("id").distinct(), k), "wide")
        more = block_survivors(again.join(wide, "id"), percent, forest=False).select("hub", "id").distinct()
        more = written(more.join(tried, ["hub", "id"], "left_anti"), "more")
        forget(wide)
        if not more.isEmpty():
            links = links.unionByName(exact_links(more, texts, k, percent))
            labels = components(links)
    forget(others, found, again)

    named = written(classes.join(labels.withColumnRenamed("id", "node"), "node", "left")
                    .select("print", F.coalesce("label", "node").alias("component")), "named")
    forget_since(docs.sparkSession, before, rows, named)
    return rows.join(named, "print", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
