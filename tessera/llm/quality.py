"""Quality by naive Bayes support vectors.

A text's features are indicators of n-grams, hashed into ``CELLS`` cells: its
words, and one to three neighbouring word shapes (kinds of characters, length,
whether the word repeats the one before). Each indicator is scaled by its
class log-count ratio, counted over all labelled rows to learn from; vectors
have length one. A linear hinge-loss model is fitted to them by dual coordinate
descent on a bounded sample (``sample_rows``), drawn towards its mean weight
and calibrated on rows it leaves out.

Nulls and ties: a null or empty text has no feature; its score is that of the
bias alone. Of repeated labels of one id the larger holds. Without labels of
both classes every score is the base rate. An empty table gives no rows.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import draw, labelled_texts, learning_labels, platt, sigmoid
from tessera.llm.shared import forget, written
from tessera.llm.textarrays import NOT_SPACE, byte_table, chunks, hash_runs, mix, runs

BITS = 18
CELLS = 1 << BITS


def kinds() -> np.ndarray:
    """A bit for each kind of byte: lower, upper, digit, sentence mark, bar, other mark, not ASCII."""
    k = np.full(256, 32, np.uint8)
    k[97:123], k[65:91], k[48:58] = 1, 2, 4
    k[[ord(c) for c in ".,;:!?'\"()-"]] = 8
    k[ord("|")] = 16
    k[128:] = 64
    return k


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text index) of the distinct features of each text."""
    s, e, doc = runs(buf, off, NOT_SPACE)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = hash_runs(buf, s, e, byte_table(fold_case=True))
    inside = kinds()[buf]
    inside[~NOT_SPACE[buf]] = 0     # blanks after a word stand in its segment
    kind = np.bitwise_or.reduceat(inside, s)
    same = np.zeros(len(s), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    size = np.minimum(e - s, 255)
    shape = (kind.astype(np.uint64) | (np.searchsorted([4, 9, 16, 40], size).astype(np.uint64) << np.uint64(8))
             | (same.astype(np.uint64) << np.uint64(12)))
    out, owner = [mix(word)], [doc]
    for n in range(1, 4):
        h = np.full(max(0, len(s) - n + 1), n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + shape[i:len(s) - n + 1 + i])
        ok = doc[:len(h)] == doc[n - 1:]
        out.append(h[ok]), owner.append(doc[:len(h)][ok])
    cell = np.concatenate(out) >> np.uint64(64 - BITS)
    both = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(BITS)) | cell)
    return (both & np.uint64(CELLS - 1)).astype(np.int64), (both >> np.uint64(BITS)).astype(np.int64)


def cell_counts(rows: DataFrame) -> DataFrame:
    """(cell, good, bad): labelled texts with each feature, over all rows (id, text, label)."""
    def task(batches):
        good, all_ = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, j, buf, off in chunks(batch.column(0)):
                cell, doc = features(buf, off)
                all_ += np.bincount(cell, minlength=CELLS)
                good += np.bincount(cell, label[i:j][doc], minlength=CELLS).astype(np.int64)
        at = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(good[at]), pa.array(all_[at] - good[at])], names=["cell", "good", "bad"])
    part = rows.select("text", F.col("label").cast("long").alias("label")).mapInArrow(task, "cell long, good long, bad long")
    return part.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def cell_totals(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each class with each cell, over all rows."""
    found = cell_counts(rows).toPandas()
    good, bad = np.zeros(CELLS), np.zeros(CELLS)
    good[found["cell"]], bad[found["cell"]] = found["good"], found["bad"]
    return good, bad


def log_ratios(good: np.ndarray, bad: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Class log-count ratio of every cell."""
    good, bad = good + smoothing, bad + smoothing
    return (np.log(good / good.sum()) - np.log(bad / bad.sum())).astype(np.float32)


def dual_descent(vectors: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, size: int, cost: np.ndarray,
                 rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last one the bias) of the L2-regularised hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(size + 1), np.zeros(len(vectors))
    own = np.array([float((v * v).sum()) + 1.0 for _, v in vectors])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(vectors)):
            at, v = vectors[i]
            gradient = sign[i] * (float(w[at] @ v) + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / own[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[at] += step * sign[i] * v
                w[size] += step * sign[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w


@dataclass
class Model:
    ratio: np.ndarray      # log-count ratio of each cell
    weight: np.ndarray     # fitted weight of each scaled cell
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, column) -> np.ndarray:
        out = []
        scaled = (self.ratio * self.weight).astype(np.float64)
        square = self.ratio.astype(np.float64) ** 2
        for i, j, buf, off in chunks(column):
            cell, doc = features(buf, off)
            norm = np.sqrt(np.bincount(doc, square[cell], minlength=j - i))
            out.append(np.bincount(doc, scaled[cell], minlength=j - i) / np.maximum(norm, 1e-9) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, held_out, label_col: str = "quality", sample_rows: int = 8000,
        calibration_rows: int = 8000, calibration: float = 0.2, shrink: float = 0.25, cost: float = 1.0,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from the labelled documents that ``held_out`` doesn't hold back.

    A fraction ``calibration`` of those rows is left out at first: the hinge-loss
    fit takes at most about ``sample_rows`` of the others, the calibration at most
    about ``calibration_rows`` of those left out, chosen by id. Then their counts
    are added, so the log-count ratios of the final model cover every labelled row.
    """
    known = learning_labels(labels, label_col, held_out, id_col)
    rows = written(labelled_texts(docs, known, id_col, text_col), "labelled")
    apart = draw("calibration") < calibration
    fitted, rest = rows.filter(~apart), rows.filter(apart)
    n, m = fitted.count(), rest.count()
    good, bad = cell_totals(fitted)
    ratio = log_ratios(good, bad)

    def task(batches):
        for batch in batches:
            label = batch.column(1)
            for i, j, buf, off in chunks(batch.column(0)):
                cell, doc = features(buf, off)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, label.slice(i, j - i)], names=["cells", "label"])
    part = fitted.filter(draw("sample") <= min(1.0, sample_rows / max(n, 1))).select("text", "label") \
        .mapInArrow(task, "cells array<int>, label int").toArrow()
    cells = part.column("cells").combine_chunks() if part.num_rows else None
    label = part.column("label").to_numpy() if part.num_rows else np.zeros(0, int)
    model = Model(ratio, np.zeros(CELLS, np.float32))
    if 0 < label.sum() < len(label):
        vectors = []
        for r in range(len(label)):
            at = cells[r].values.to_numpy()
            v = ratio[at].astype(float)
            vectors.append((at, v / max(float(np.sqrt((v * v).sum())), 1e-9)))
        share = label.mean()
        w = dual_descent(vectors, np.where(label == 1, 1.0, -1.0), CELLS,
                         cost * np.where(label == 1, 0.5 / share, 0.5 / (1 - share)))
        mean = float(np.abs(w[:CELLS]).sum()) / max(int(np.count_nonzero(w[:CELLS])), 1)
        model.weight = ((1 - shrink) * w[:CELLS] + shrink * mean).astype(np.float32)
        model.bias = float(w[CELLS])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.margins(batch.column(0))), batch.column(1)], names=["margin", "label"])
    seen = rest.filter(draw("sample") <= min(1.0, calibration_rows / max(m, 1))).select("text", "label") \
        .mapInArrow(margins, "margin double, label int").toPandas()
    model.slope, model.offset = platt(seen["margin"].to_numpy(float), seen["label"].to_numpy())
    more_good, more_bad = cell_totals(rest)
    model.ratio = log_ratios(good + more_good, bad + more_bad)
    forget(rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, margin, score) of every row; score is the calibrated probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in batches:
            m = sent.value.margins(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m), pa.array(sigmoid(sent.value.slope * m + sent.value.offset))],
                                             names=["id", "margin", "score"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(task, "id long, margin double, score double")
