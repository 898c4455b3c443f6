"""Documents with their labels, and one-dimensional calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.idfilter import id_filter, passes
from tessera.llm.shared import id_remainder


def learning_labels(labels: DataFrame, label_col: str, held_out, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labels to learn from: one row an id, the larger label of repeated ones.

    ``held_out(column)`` tells the ids not to learn from; null ids and labels are left out.
    """
    return (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
            .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
            .groupBy("id").agg(F.max("label").alias("label")))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of the labelled documents. Only texts that pass a fixed-size
    filter of the labels' ids are moved by the join."""
    chosen = docs.sparkSession.sparkContext.broadcast(id_filter(labels.select("id")))

    def task(batches):
        for batch in batches:
            yield batch.filter(passes(chosen.value, batch.column(0)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(task, "id long, text string").join(labels, "id")


def draw(salt: str, id_col: str = "id"):
    """A uniform number from the id alone, to deal rows into folds and bounded samples."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def third(remainder: int):
    """Rule "crc32(id as text) mod 3 is ``remainder``" on an id column."""
    return lambda c: id_remainder(c, 3) == remainder


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of sigmoid(slope * margin + offset), by Newton's method with smoothed targets."""
    pos, neg = float((label == 1).sum()), float((label == 0).sum())
    if not len(label) or not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    scale = float(np.std(margin)) or 1.0
    x = margin / scale
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a, b):
        z = a * x + b
        return float((np.logaddexp(0, z) - t * z).sum() + 1e-6 * a * a)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g, w = p - t, p * (1 - p) + 1e-12
        gradient = np.array([(g * x).sum() + 2e-6 * a, g.sum()])
        hessian = np.array([[(w * x * x).sum() + 2e-6, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-9:
            break
    return a / scale, b


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
