"""Repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words of one text. Its minimiser is the least
hash of its runs of ``m`` words; consecutive windows with one minimiser travel
as one packed string, the text from the first window's first word to the last
one's last, to the bucket of that minimiser. Equal windows have equal
minimisers, so a bucket holds every window equal to one of its own, and sorting
the bucket's windows word by word (ranks of 1, 2, 4 ... words, from the words'
bytes) counts them exactly. Hashes choose buckets; they never decide equality.

What travels: a first scan counts minimisers (eight bytes for some sixteen
words); only strings whose minimiser occurs twice are packed, thinned by a
filter of bounded size that lets false ones pass but loses none. Equal strings
leave a task once. A bucket above ``PART`` bytes, such as that of a passage a
third of all texts hold, is dealt in parts by window: a string goes to each
part that one of its windows falls in, so the parts count apart.

A word that a window with a count of two or more covers is removed, in every
place; windows are judged on the input.

Nulls, ties, repeats: a null text has no words. Texts of fewer than ``k`` words
lose nothing. Repeated rows count as often as they stand, so their windows are
repeated ones. A row is known by its id and a hash of its text, null ids too.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.idfilter import bits_for, id_filter, passes
from tessera.llm.shared import forget, written
from tessera.llm.textarrays import NOT_SPACE, byte_table, chunks, hash_runs, ragged, release, runs, shingle_hashes

RUN = 62                 # windows of a packed string at most: a bit each of one long
PART = 4 << 20           # bytes of packed strings of a bucket that isn't dealt in parts, and of a part on average
TOGETHER = 8 << 20       # bytes of packed strings sorted at a time
GATHERED = 1 << 16       # words gathered at a time


class Windows:
    """The windows of a slice of texts, in runs that share a minimiser."""

    def __init__(self, buf, off, k: int, m: int):
        starts, ends, doc = runs(buf, off, NOT_SPACE)
        n = len(off) - 1
        count = np.bincount(doc, minlength=n)
        long = (count >= k)[doc]
        self.starts, self.ends = starts[long], ends[long]
        doc = doc[long]
        count = np.where(count >= k, count, 0)
        first = np.cumsum(count) - count
        words = hash_runs(buf, self.starts, self.ends, byte_table())
        mers, _ = shingle_hashes(words, doc, n, m)
        self.mers = mers
        per = np.maximum(count - k + 1, 0)
        owner = np.repeat(np.arange(n), per)
        each = np.where(count > 0, count - m + 1, 0)                          # runs of m words
        at = ragged(np.cumsum(each) - each, per)
        # least hash of k - m + 1 neighbours, by doubling
        width, span, least = k - m + 1, 1, mers
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0]
            span *= 2
        value = np.minimum(least[at], least[at + width - span]) if len(at) else mers[:0]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        cuts = -(-size // RUN)
        part = ragged(np.zeros(len(head), np.int64), cuts)
        begin = np.repeat(head, cuts) + part * RUN
        self.size = np.minimum(np.repeat(size, cuts) - part * RUN, RUN)      # windows
        self.value, self.doc = value[begin], owner[begin]
        word = ragged(first, per)[begin]
        self.start = word - first[self.doc]                                   # word of its text
        self.lo = self.starts[word]
        self.hi = self.ends[word + self.size + k - 2] if len(word) else word

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Minimisers and how often each occurs, two where a run may hold it twice."""
        by_hash = np.sort(self.mers)
        twice = np.unique(by_hash[1:][by_hash[1:] == by_hash[:-1]])
        value, n = np.unique(self.value, return_counts=True)
        return value, np.maximum(n, 2 * np.isin(value, twice))


def word_ranks(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for equal words, by their bytes."""
    sizes = ends - starts
    # some words at a time: a byte takes eight to address
    data = np.concatenate([buf[ragged(starts[lo:lo + GATHERED], sizes[lo:lo + GATHERED])] for lo in range(0, max(len(sizes), 1), GATHERED)])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def window_ranks(rank: np.ndarray, k: int) -> np.ndarray:
    """The same number for equal sequences of ``k`` ranks, for every start that has them; sorted pairs, doubled."""
    def joined(a, b):
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].ravel()
    span = 1
    while 2 * span <= k:
        rank = joined(rank[:-span], rank[span:]) if len(rank) > span else rank[:0]
        span *= 2
    rest = k - span
    if not rest:
        return rank
    return joined(rank[:-rest], rank[rest:]) if len(rank) > rest else rank[:0]


def repeated_windows(packed: pa.Array, times: np.ndarray, sub: np.ndarray, parts: np.ndarray, k: int) -> np.ndarray:
    """Masks of the windows of each string that occur twice or more in ``packed``, each string standing for ``times``.

    Of a string of a dealt bucket only the windows that belong to part ``sub`` of ``parts`` are judged.
    """
    buf, off = texts_of(packed)
    starts, ends, row = runs(buf, off, NOT_SPACE)
    n = np.bincount(row, minlength=len(packed))
    per = n - k + 1
    at = ragged(np.cumsum(n) - n, per)
    owner = np.repeat(np.arange(len(packed)), per)
    place = ragged(np.zeros(len(packed), np.int64), per)
    if (parts > 1).any():
        own = parts_of(buf, starts, ends, row, len(packed), parts, k) == sub[owner]
        at, owner, place = at[own], owner[own], place[own]
    rank = window_ranks(word_ranks(buf, starts, ends), k)[at]
    count = np.bincount(rank, weights=times[owner])
    hit = count[rank] >= 2
    mask = np.zeros(len(packed), np.int64)
    np.bitwise_or.at(mask, owner[hit], np.int64(1) << place[hit])
    return mask


def texts_of(column: pa.Array):
    buf, off = texts_buffers(column)
    return buf[off[0]:off[-1]], off - off[0]


def texts_buffers(column):
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def parts_of(buf, starts, ends, row, n: int, parts: np.ndarray, k: int) -> np.ndarray:
    """The part of its bucket that each window of ``n`` strings falls in."""
    hashes, owner = shingle_hashes(hash_runs(buf, starts, ends, byte_table()), row, n, k)
    return (hashes % parts[owner].astype(np.uint64)).astype(np.int64)


def shared_minimisers(rows: DataFrame, k: int, m: int) -> DataFrame:
    """(value): minimisers that stand in two places or more."""
    def task(batches):
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                value, weight = Windows(buf, off, k, m).weights()
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(weight.astype(np.int64))], names=["value", "n"])
        release()
    counted = rows.select("text").mapInArrow(task, "value long, n long")
    return counted.groupBy("value").agg(F.sum("n").alias("n")).filter("n > 1").select("value")


PACKED = "value long, id long, text_hash long, start long, packed binary"


def packed_strings(rows: DataFrame, chosen, k: int, m: int) -> DataFrame:
    """The runs whose minimiser passes the filter, with their words: (value, id, text_hash, start, packed)."""
    def task(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for lo, _, buf, off in chunks(batch.column(2)):
                w = Windows(buf, off, k, m)
                keep = np.flatnonzero(np.asarray(passes(chosen.value, pa.array(w.value.view(np.int64)))))
                for part in np.array_split(keep, max(1, len(keep) // 8192)):
                    doc = pa.array(lo + w.doc[part])
                    data = [buf[a:b].tobytes() for a, b in zip(w.lo[part], w.hi[part])]
                    yield pa.RecordBatch.from_arrays([pa.array(w.value[part].view(np.int64)), ids.take(doc), hashes.take(doc),
                                                      pa.array(w.start[part]), pa.array(data, pa.binary())],
                                                     names=["value", "id", "text_hash", "start", "packed"])
        release()
    return rows.select("id", "text_hash", "text").mapInArrow(task, PACKED)


def dealt_parts(strings: DataFrame, k: int) -> DataFrame:
    """Strings of large buckets, once for each part that one of their windows falls in."""
    def task(batches):
        for batch in batches:
            buf, off = texts_of(batch.column(1))
            starts, ends, row = runs(buf, off, NOT_SPACE)
            parts = batch.column(4).to_numpy()
            n = np.bincount(row, minlength=batch.num_rows)
            owner = np.repeat(np.arange(batch.num_rows), n - k + 1)
            pairs = np.unique(np.stack([owner, parts_of(buf, starts, ends, row, batch.num_rows, parts, k)]), axis=1)
            for lo in range(0, pairs.shape[1], 8192):
                own, sub = pairs[:, lo:lo + 8192]
                some = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sub)], names=["value", "packed", "n", "digest", "parts", "sub"])
        release()
    return strings.mapInArrow(task, "value long, packed binary, n long, digest binary, parts long, sub long")


def counted_windows(strings: DataFrame, k: int) -> DataFrame:
    """(digest, mask) of the distinct strings (value, packed, n, digest) that hold repeated windows."""
    # a string of some sixteen windows goes to as many parts
    size = F.sum(F.length("packed"))
    sizes = strings.groupBy("value").agg(F.when(size > PART, F.ceil(16 * size / PART)).otherwise(1).cast("long").alias("parts"))
    large = written(sizes.filter("parts > 1"), "large")
    placed = strings.join(large, "value", "left").select("value", "packed", "n", "digest", F.coalesce("parts", F.lit(1)).cast("long").alias("parts"))
    whole = placed.filter("parts = 1").withColumn("sub", F.lit(0).cast("long"))
    both = whole.unionByName(dealt_parts(placed.filter("parts > 1"), k))
    buckets = both.repartition("value", "sub").sortWithinPartitions("value", "sub")

    def task(batches):
        held, size = [], 0

        def judged(group):
            table = pa.Table.from_batches(group).combine_chunks()
            cols = {c: table.column(c).combine_chunks() for c in table.column_names}
            masks = repeated_windows(cols["packed"], cols["n"].to_numpy(), cols["sub"].to_numpy(), cols["parts"].to_numpy(), k)
            some = np.flatnonzero(masks)
            return pa.RecordBatch.from_arrays([cols["digest"].take(pa.array(some)), pa.array(masks[some])], names=["digest", "mask"])
        for batch in batches:
            value, sub = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            done = np.cumsum(np.diff(texts_buffers(batch.column(1))[1]))
            lo = 0
            # a bucket may go on in the next batch: cut where another one begins
            heads = np.flatnonzero((np.diff(value) != 0) | (np.diff(sub) != 0)) + 1
            if held and len(value):
                last = held[-1]
                if (last.column(0)[-1].as_py(), last.column(5)[-1].as_py()) != (value[0], sub[0]):
                    heads = np.concatenate([[0], heads])
            for cut in heads:
                if size + (done[cut - 1] if cut else 0) - (done[lo - 1] if lo else 0) >= TOGETHER:
                    if cut > lo:
                        held.append(batch.slice(lo, cut - lo))
                    yield judged(held)
                    held, size, lo = [], 0, cut
            if lo < len(value):
                held.append(batch.slice(lo))
                size += int(done[-1] - (done[lo - 1] if lo else 0))
        if held:
            yield judged(held)
        held = []
        release()
    masks = buckets.mapInArrow(task, "digest binary, mask long")
    return masks.groupBy("digest").agg(F.bit_or("mask").alias("mask"))


RESULT = "id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def drop_repeats(docs: DataFrame, k: int = 35, m: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept): every row's text without the words of repeated ``k``-word windows.

    ``spans`` are the removed stretches as word positions, ``kept`` the words that stay, joined by one space.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    shared = written(shared_minimisers(rows, k, m), "minimisers")
    chosen = spark.sparkContext.broadcast(id_filter(shared, bits_for(shared.count())))
    strings = written(packed_strings(rows, chosen, k, m).withColumn("digest", F.unhex(F.sha2("packed", 256))), "strings")
    distinct = written(strings.groupBy("value", "packed", "digest").agg(F.count(F.lit(1)).alias("n"))
                       .select("value", "packed", "n", "digest"), "distinct")
    masks = written(counted_windows(distinct, k), "masks")
    forget(distinct, shared)
    hits = strings.select("digest", "id", "text_hash", "start").join(masks, "digest")
    found = written(hits.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "mask")).alias("hits")), "found")
    forget(strings, masks)
    touched = spark.sparkContext.broadcast(id_filter(found.select("text_hash"), bits_for(found.count())))

    def split(wanted: bool):
        def task(batches):
            for batch in batches:
                keep = passes(touched.value, batch.column(1))
                yield batch.filter(keep if wanted else pc.invert(keep))
        return rows.mapInArrow(task, "id long, text_hash long, text string")
    mine = found.select(F.col("id").alias("found_id"), F.col("text_hash").alias("found_hash"), "hits")
    some = split(True)
    some = some.join(mine, some["id"].eqNullSafe(mine["found_id"]) & (some["text_hash"] == mine["found_hash"]), "left").select("id", "text", "hits")
    rest = split(False).select("id", "text", F.lit(None).cast("array<struct<start:long,mask:long>>").alias("hits"))

    def task(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [without(t.as_buffer().to_pybytes(), h, k) for t, h in zip(part.column(1).cast(pa.large_binary()), part.column(2).to_pylist())]
                n, gone, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])
        release()
    return some.unionByName(rest).mapInArrow(task, RESULT)


def without(text: bytes, hits: list[dict] | None, k: int):
    """(words, removed words, removed stretches, kept text) of one text and its repeated windows."""
    words = text.split()
    if not hits:
        return len(words), 0, [], b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for hit in hits:
        at = hit["start"] + np.flatnonzero(np.array([hit["mask"]], np.int64).view(np.uint64) >> np.arange(RUN, dtype=np.uint64) & np.uint64(1))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
    gone = np.cumsum(edge[:-1]) > 0
    cut = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    spans = [{"start": int(a), "end": int(b)} for a, b in cut.reshape(-1, 2)]
    return len(words), int(gone.sum()), spans, b" ".join([w for w, g in zip(words, gone) if not g])
