"""Adapters from the driver's parquet tables to the data model of the library.

Every adapter is a lazy plan over the parquet scans, so filters and column
pruning reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ROWS_A_TASK = 1 << 19   # order lines that a task joins and aggregates where there are many
FEW_TASKS = 8           # as many tasks' lines are few: Spark plans them as it likes


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings triple ``(user_id, item_id, rating)``: customer x part, rating =
    ceil(avg(quantity)/10) in 1..5.

    Plan: lineitem and orders are joined on the order key (shuffle join at
    scale, broadcast when AQE sees a small side), then one hash aggregate on
    (customer, part). Many lines are dealt over as many tasks as hold
    ``ROWS_A_TASK`` each (their number is read from the files' footers), so a
    task's sorts and hash maps don't grow with the tables.
    """
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = max(li.count(), od.count()) // ROWS_A_TASK + 1
    many = tasks > FEW_TASKS
    if many:
        li, od = li.repartition(tasks, "l_orderkey"), od.repartition(tasks, "o_orderkey")
    lines = (li.join(od, li.l_orderkey == od.o_orderkey)
             .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity"))
    if many:
        lines = lines.repartition(tasks, "user_id", "item_id")
    return lines.groupBy("user_id", "item_id").agg(F.ceil(F.avg("l_quantity") / 10).cast("int").alias("rating"))


def labelled_documents(spark: SparkSession, sf_dir: str, label_col: str = "quality") -> DataFrame:
    """Labelled corpus ``(doc_id, text, label)``: documents joined with labels."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col(label_col).cast("int").alias("label"))
    return docs.join(labels, "doc_id")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors ``(item_id, vec ARRAY<DOUBLE>, label)`` from ``embeddings``."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        "label")
