"""Placement by a hierarchical weighted hash tree, in DataFrame functions only.

A tree is ``{region: {rack: {shard: weight}}}``. A key descends region, rack
and shard; at each level every child draws ``-ln(u) / weight`` from the hash of
(key, path of the child) and the smallest draw wins, so a child is chosen in
proportion to its weight. A draw depends on nothing but its own node, hence a
change of weights moves keys only into or out of the nodes whose weight
changed; a shard that is added as a new region takes keys only into itself.

The law is ``key``: the id and the tree decide. Equal texts are not looked at.
Null ids are one key; repeated ids go to one shard. Slots number a shard's rows
by (bucket of the id's hash, id, crc, size) without gaps; no task sees a whole
shard. Rows of an id with more than ``ROWS_PER_BUCKET`` of them are dealt over
all buckets by their place in the written table. Columns other than the id and the text are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import written

ROWS_PER_BUCKET = 50_000


def uniform_tree(regions: int, racks: int, shards: int) -> dict:
    """Equal weights; shards are numbered in order."""
    number = iter(range(regions * racks * shards))
    return {r: {k: {next(number): 1.0 for _ in range(shards)} for k in range(racks)} for r in range(regions)}


def grown_tree(tree: dict, weight: float = 1.0) -> dict:
    """The tree with one more shard, alone in a rack of a new region."""
    last = max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, max(tree) + 1: {0: {last + 1: weight}}}


def draw(key: Column, path: str, weight: float) -> Column:
    """The node's draw for a key: exponential with rate ``weight``."""
    hexa = F.substring(F.md5(F.concat(key, F.lit(f"|{path}"))), 1, 12)
    u = (F.conv(hexa, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / F.lit(float(weight))


def total(node) -> float:
    return float(node) if not isinstance(node, dict) else sum(total(x) for x in node.values())


def choose(key: Column, node: dict, path: str = "") -> Column:
    """The shard of a key under a node: descend to the child with the smallest draw."""
    children = [(f"{path}/{name}", name, child) for name, child in node.items() if total(child) > 0]
    below = [choose(key, child, p) if isinstance(child, dict) else F.lit(int(name)) for p, name, child in children]
    if len(children) == 1:
        return below[0]
    draws = [draw(key, p, total(child)) for p, _, child in children]
    least = F.array_position(F.array(*draws), F.array_min(F.array(*draws)))
    out = below[-1]
    for i in reversed(range(len(below) - 1)):
        out = F.when(least == i + 1, below[i]).otherwise(out)
    return out


def place(rows: DataFrame, tree: dict, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``rows`` with the shard of every id."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return rows.withColumn(name, choose(key, tree).cast("int"))


def shard_rows(docs: DataFrame, tree: dict, grown: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, gapless slot and shard in the grown tree of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = place(place(rows, tree, "doc_id", "shard"), grown, "doc_id", "grown_shard")
    rows = written(rows, "placed").select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("place"))
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    # fewer than one id for each ROWS_PER_BUCKET rows
    hot = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ROWS_PER_BUCKET).select(F.col("doc_id").alias("hot_id"), F.lit(True).alias("hot"))
    rows = rows.join(hot, rows["doc_id"].eqNullSafe(hot["hot_id"]), "left")
    rows = rows.withColumn("bucket", F.pmod(F.when(F.col("hot"), F.col("place")).otherwise(F.xxhash64("doc_id")), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "place")
    return (rows.withColumn("at", F.row_number().over(order) - 1).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("start") + F.col("at")).alias("slot"), "grown_shard"))
