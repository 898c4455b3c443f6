"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups.

Texts are grouped by (hash, text): Spark's hash aggregate combines copies
inside each task, so a text that a third of all rows hold leaves a task once,
and two texts that collide in the hash stay apart because the grouping key
compares their bytes. Only the narrow groups table is joined back to the rows;
it is written first, so the join has an exchange on both sides and a hot hash
can be split by adaptive execution.

Nulls and ties: a null text counts as empty, so null and empty texts are equal.
A repeated row is one more member of its group; of rows with the kept id one
stays. Null ids are kept only where a group has no other. Columns other than
the id and the text are carried by :func:`drop_duplicates`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import written


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def text_groups(docs: DataFrame, id_col: str, text_col: str, keep: str = "smallest",
                hash_fn: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """Every distinct text: (hash, text or null, keep_id, group_size).

    ``text`` is filled only for hashes that several texts share.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keeper = F.min("id") if keep == "smallest" else F.max("id")
    each = (docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("hash", hash_fn(F.col("text")))
            .groupBy("hash", "text").agg(keeper.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    texts = F.count(F.lit(1)).over(Window.partitionBy("hash"))
    return (each.withColumn("texts", texts)
            .select("hash", F.when(F.col("texts") > 1, F.col("text")).alias("text"), "keep_id", "group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 hash_fn: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    ``keep``: "smallest" or "largest" id of the group stays.
    """
    groups = written(text_groups(docs, id_col, text_col, keep, hash_fn), "groups")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("hash", hash_fn(F.col("t")))
    sha = F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    alone = groups.filter("text is null").select("hash", "keep_id", "group_size")
    out = rows.select("id", "hash", sha).join(alone, "hash").select("id", "keep_id", "group_size", "text_sha256")
    collided = groups.filter("text is not null")
    if not collided.isEmpty():
        # texts that share a hash: the join compares the bytes too
        apart = rows.join(collided.withColumnRenamed("text", "other"), "hash").filter(F.col("t") == F.col("other"))
        out = out.unionByName(apart.select("id", "keep_id", "group_size", sha))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      (F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                    hash_fn: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: the smallest (largest) id's.

    One aggregate by (hash, text): copies inside a task are combined before the shuffle.
    """
    names = docs.columns
    others = [F.when(F.col(f"`{c}`").isNull(), F.lit(False)).otherwise(F.lit(True)).alias(f"c{i}") if c == text_col
              else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    rank = F.struct(F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull(), F.col("id"))
    pick = F.min_by("row", rank) if keep == "smallest" else F.max_by("row", rank)
    packed = docs.select(F.struct(*others).alias("row"), F.col(f"`{id_col}`").alias("id"),
                         F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kept = packed.withColumn("hash", hash_fn(F.col("text"))).groupBy("hash", "text").agg(pick.alias("row"))
    return kept.select(*[(F.when(F.col("row")[f"c{i}"], F.col("text")) if c == text_col else F.col("row")[f"c{i}"]).alias(c)
                         for i, c in enumerate(names)])
