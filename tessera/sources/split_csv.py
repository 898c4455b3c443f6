"""Quoted CSV read by many tasks a file (A4).

Spark's multi-line CSV reader gives a whole file to one task, since a line end
may stand inside quotes. Here lines are read with splits, and whether a split
begins inside a quote follows from the number of quote characters before it: a
first pass counts quotes by split, their prefix sums modulo two tell the state
at each split's start, and a second pass joins lines to records from there on.
A record cut by split borders is put together again from its parts.

The quote character is doubled inside quoted fields (as RFC 4180 has it), and
must not stand in unquoted ones. Line ends are LF or CRLF.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, OPEN, MIDDLE, CLOSE = range(4)      # a record; its first part, a part of full splits, its last part


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"))


def _splits(batch: pa.RecordBatch):
    """(first row, end row) of each split in a batch."""
    split = batch.column(2).to_numpy()
    file = batch.column(1).dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((np.diff(split) != 0) | (np.diff(file) != 0)) + 1
    return zip([0, *cut], [*cut, batch.num_rows])


def splits_inside_quotes(lines: DataFrame, quote: str) -> list[tuple[str, int]]:
    """(file, split) of the splits that begin inside a quote: at most one row for each split of the input."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                n = pc.count_substring(batch.column(0), quote).to_numpy()
                rows = [(batch.column(1)[int(a)].as_py(), batch.column(2)[int(a)].as_py(), int(n[a:b].sum())) for a, b in _splits(batch)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["file", "split", "n"])
    counted = lines.mapInArrow(task, "file string, split long, n long").groupBy("file", "split").agg((F.sum("n") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    found = counted.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).filter("inside = 1").select("file", "split")
    return [(r["file"], r["split"]) for r in found.collect()]


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, split, at, record)``: the records of all files as text, quotes and inner line ends included; ``split`` and
    ``at`` (place in the split) order the records of a file."""
    lines = _lines(spark, path)
    inside = spark.sparkContext.broadcast(set(splits_inside_quotes(lines, quote)))

    def task(batches):
        at, state = None, {}

        def parts(line, odd):
            """Whole records and fragments of one split's lines, given the state so far."""
            out = []
            for text, flip in zip(line, odd):
                state["held"].append(text)
                state["quoted"] ^= flip
                if state["quoted"]:
                    continue
                record = b"\n".join(state["held"])
                out.append((CLOSE if state["cut"] else WHOLE, state["at"], record[:-1] if record.endswith(b"\r") else record))
                state.update(held=[], cut=False, at=state["at"] + 1)
            return out

        def rest():
            """What the split leaves unfinished."""
            return [(MIDDLE if state["cut"] else OPEN, state["at"], b"\n".join(state["held"]))] if state.get("held") else []

        def rows(out):
            if out:
                kind, place, record = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(out)), pa.array([at[1]] * len(out)), pa.array(place, pa.int64()),
                                                  pa.array(kind, pa.int32()), pa.array(record, pa.binary())], names=["file", "split", "at", "kind", "record"])
        for batch in batches:
            if not batch.num_rows:
                continue
            odd = pc.count_substring(batch.column(0), quote).to_numpy() % 2 == 1
            for lo, hi in _splits(batch):
                name = (batch.column(1)[int(lo)].as_py(), batch.column(2)[int(lo)].as_py())
                if name != at:
                    yield from rows(rest())
                    at = name
                    state = {"held": [], "quoted": name in inside.value, "cut": name in inside.value, "at": 0}
                for a in range(lo, hi, 4096):
                    b = min(hi, a + 4096)
                    yield from rows(parts(batch.column(0).slice(a, b - a).to_pylist(), odd[a:b].tolist()))
        yield from rows(rest())
    found = lines.mapInArrow(task, "file string, split long, at long, kind int, record binary")
    whole = found.filter(F.col("kind") == WHOLE).select("file", "split", "at", "record")
    # parts of a record: one that opens, any that fill whole splits, one that closes (missing at the end of a file)
    order = Window.partitionBy("file").orderBy("split", "at")
    cut = found.filter(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    joined = cut.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("split", "at", "record"))).alias("p")) \
        .select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["at"].alias("at"),
                F.array_join(F.transform("p", lambda x: x["record"].cast("string")), "\n").cast("binary").alias("record"))
    return whole.unionByName(joined).select("file", "split", "at", F.col("record").cast("string").alias("record"))


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",", quote: str = '"') -> DataFrame:
    """A4 for large files: the rows of quoted CSV files with line ends inside fields, every split read by its own task.

    ``header`` drops the first record of each file. Empty lines are no records. Fields that don't cast are null.
    """
    records = csv_records(spark, path, quote).filter(F.col("record") != "")
    if header:
        records = records.filter(~((F.col("split") == 0) & (F.col("at") == 0)))
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}
    return records.select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
