"""A Bloom filter of ids or hashes of a bounded size, to thin a table before a join moves its texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textarrays import mix

BLOOM_BITS = 1 << 24   # 2 MB where the number of ids is not told
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28   # 32 MB at most: beyond some 30 million keys it thins less, and never loses a key


def bits_for(keys: int) -> int:
    """Eight bits a key, a power of two within the limits."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * max(keys, 1) - 1).bit_length()))


def bloom_positions(ids: np.ndarray, size: int = BLOOM_BITS) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(99))
    return np.stack([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def id_filter(ids: DataFrame, size: int = BLOOM_BITS) -> np.ndarray:
    """The filter of a column of ids, as 64-bit words; tasks send the words they set."""
    def task(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            bits[bloom_positions(batch.column(0).to_numpy(), size).ravel()] = 1
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at])], names=["at", "word"])
    rows = (ids.mapInArrow(task, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow())
    words = np.zeros(size // 64, np.int64)
    words[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return words


def passes(words: np.ndarray, ids: pa.Array) -> pa.Array:
    """Mask of the ids that may be in the filter (null: no)."""
    ids = ids.cast(pa.int64())
    value = ids.fill_null(0).to_numpy()
    keep = np.asarray(ids.is_valid())
    for pos in bloom_positions(value, 64 * len(words)):
        keep = keep & ((words[pos >> 6].view(np.uint64) >> (pos & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return pa.array(keep)


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` without those whose id is in ``ids`` (one column); rows without an id stay.

    Both sides of the join come from an exchange at every size, so a hot id can
    be split; rows without an id don't take part in it.
    """
    ids = ids.toDF("__dropped").filter("__dropped is not null").hint("merge")
    known = rows.filter(F.col(f"`{id_col}`").isNotNull())
    kept = known.join(ids, known[f"`{id_col}`"] == ids["__dropped"], "left_anti")
    return kept.union(rows.filter(F.col(f"`{id_col}`").isNull()))
