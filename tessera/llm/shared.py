"""Tables written to the folder all executors share, and small column helpers.

Iterative operators cut their lineage by writing a Parquet table under the
folder named by ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs at most the tasks that had not been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder (``spark.checkpoint.dir``; a local one only where it is unset)."""
    return ensure_checkpoint_dir(spark).rstrip("/")


#: Paths of the tables that :func:`written` made and that aren't deleted yet.
live: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    live.add(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` whose last reader has been written."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            delete(t.sparkSession, {path})


def delete(spark: SparkSession, paths: set[str]) -> None:
    """Delete written tables by path."""
    for path in paths & live:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        live.discard(path)


def forget_since(spark: SparkSession, before: set[str], *kept: DataFrame) -> None:
    """Delete the tables written since ``live`` was ``before``, but for those still read."""
    delete(spark, live - before - {t.written_path for t in kept})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(key: str | Column, k: int) -> Column:
    """crc32 of the key as text, modulo ``k`` (null keys count as empty text)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(k))
