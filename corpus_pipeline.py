"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, jaccard, mixing, packing, toxicity
from tessera.llm.idfilter import without_ids
from tessera.llm.queries import digest, vocabulary
from tessera.llm.shared import delete, forget, forget_since, live, table, written

#: Packing, raking and the Kneser-Ney scores have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, learned from all labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda c: F.lit(False))
    return toxicity.keep_clean(docs, model, 0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every text."""
    return exact.drop_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group linked by five-word shingles at a similarity of 0.8 or more."""
    before = set(live)
    groups = written(jaccard.jaccard_join(docs, k=5, percent=80), "groups")
    forget_since(spark, before, groups)
    return without_ids(docs, groups.filter("component_id <> id").select("id"), "doc_id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of 0.8 of the tokens, raked to tempered source, language and topic shares."""
    return mixing.sample(docs, keep=0.8, temper=0.7)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return digest(packing.pack(docs, vocabulary(), 1024))


_left: set[str] = set()


def tidy(stage):
    """``stage``, after the tables that earlier stages left have been deleted: a stage begins when the one before is written."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        _left.clear()
        before = set(live)
        out = stage(spark, docs, sf_dir)
        _left.update(live - before)
        return out
    return run_stage


STAGES = [(name, tidy(stage)) for name, stage in (
    ("toxicity", clean), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar), ("mixing", mixed), ("packing", packed))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = written(out, f"stage{i}")
            forget(docs)
        docs = out
    return docs
