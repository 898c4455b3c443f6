"""Language of a text by averaged hashed subword embeddings.

Subwords are the two, three and four byte windows of the letters (A-Z folded,
runs of other bytes one blank), hashed into ``CELLS`` cells with an embedding
each. A text is the average of its subwords' embeddings, and a linear softmax
on it gives the language. Embeddings and softmax are trained by stochastic
gradient descent in numpy on a bounded sample of the rows to learn from
(``sample_rows``); rows left out calibrate the temperature and the score below
which an answer is rejected. As the model is linear, scoring adds up one row of
``embedding @ softmax`` a subword.

Nulls and ties: a null text or one without letters is ``und`` with score 0 and
rejected. Rows without a language aren't learned from but answered. Repeated
rows are answered each. Without rows to learn from every answer is ``und``. An
empty table gives no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import draw
from tessera.llm.textarrays import chunks
from tessera.llm.toxicity import letter_stream

BITS, WIDTH = 16, 16
CELLS = 1 << BITS
LENGTHS = (2, 3, 4)
PIECE = 1 << 19      # bytes scored at a time


def subwords(buf: np.ndarray, off: np.ndarray):
    """Yield (cell, text index) of the windows of each length."""
    if not len(buf):
        return
    b, doc = letter_stream(buf, off)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(b) < n:
            return
        code = (code[:len(b) - n + 1] << np.uint32(8)) | b[n - 1:]
        if n in LENGTHS:
            ok = doc[:len(code)] == doc[n - 1:]
            cell = ((code ^ np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            yield cell[ok].astype(np.int64), doc[:len(code)][ok]


@dataclass
class Model:
    names: list[str]
    logit: np.ndarray           # cells x languages: embedding @ softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, column) -> np.ndarray:
        """Probabilities of the languages for every text."""
        out = []
        for i, j, buf, off in chunks(column, PIECE):
            total, n = np.zeros((j - i, len(self.names))), np.zeros(j - i)
            for cell, doc in subwords(buf, off):
                if len(cell):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    total[doc[first]] += np.add.reduceat(self.logit[cell], first, axis=0, dtype=np.float64)
                    n += np.bincount(doc, minlength=j - i)
            out.append(softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature))
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Bags:
    """Views of the sampled texts' cells; shares are made when a text is asked for."""

    def __init__(self, at: np.ndarray, cell: np.ndarray, times: np.ndarray):
        self.at, self.cell, self.times = at, cell, times

    def __len__(self):
        return len(self.at) - 1

    def __getitem__(self, i: int):
        a, b = self.at[i], self.at[i + 1]
        t = self.times[a:b].astype(np.float32)
        return self.cell[a:b], t / max(float(t.sum()), 1.0)


class Chosen:
    """Some of the bags, by index."""

    def __init__(self, bags: Bags, rows: np.ndarray):
        self.bags, self.rows = bags, rows

    def __getitem__(self, i: int):
        return self.bags[self.rows[i]]


def train(bags, label: np.ndarray, names: list[str], rounds: int = 6,
          rate: float = 20.0, seed: int = 3):
    """(embedding @ softmax, bias) from bags of (cells, shares), by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    # a rare language's rows are shown several times a round
    many = np.bincount(label, minlength=len(names))
    shown = np.repeat(np.arange(len(label)), np.maximum(1, np.ceil(0.02 * len(label) / np.maximum(many, 1)).astype(int))[label])
    embed = rng.normal(0, 0.1, (CELLS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = rounds * len(shown), 0
    for _ in range(rounds):
        for i in shown[rng.permutation(len(shown))]:
            cell, part = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(cell):
                continue
            mean = part @ embed[cell]
            p = softmax((mean @ weight + bias)[None])[0]
            p[label[i]] -= 1
            back = weight @ p
            weight -= 0.01 * lr * np.outer(mean, p)
            bias -= 0.001 * lr * p
            embed[cell] -= (lr * part)[:, None] * back
    return embed @ weight, bias


def fit(docs: DataFrame, learn, sample_rows: int = 4000, floor: int = 40, calibration: float = 0.25, precision: float = 0.995,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from at most about ``sample_rows`` of the rows with a language for which ``learn(id)`` holds, chosen by id,
    but about ``floor`` of each language (all, if it has fewer), so every language of the table is learned.

    A fraction ``calibration`` of the sample sets the temperature and the least
    score at which the share of right answers reaches ``precision``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & learn(F.col("id")))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()     # one row a language
    share = sample_rows / max(sum(r["n"] for r in per), 1)
    chances = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, max(share, 2 * floor / r["n"] if r["n"] * share < floor else 0.0)))
                                                 for r in per], "lang string, chance double")
    sample = rows.join(chances, "lang").filter(draw("language") <= F.col("chance"))

    def task(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(0), PIECE):
                found = list(subwords(buf, off))
                cell = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
                doc = np.concatenate([d for _, d in found]) if found else np.zeros(0, np.int64)
                both, times = np.unique((doc << BITS) | cell, return_counts=True)
                cut = np.searchsorted(both >> BITS, np.arange(j - i + 1))
                cells = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(both & (CELLS - 1), pa.int32()))
                counts = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times, pa.int32()))
                yield pa.RecordBatch.from_arrays([cells, counts, *(batch.column(c).slice(i, j - i) for c in (1, 2))],
                                                 names=["cells", "counts", "lang", "apart"])
    part = sample.select("text", "lang", (draw("apart") < calibration).alias("apart")) \
        .mapInArrow(task, "cells array<int>, counts array<int>, lang string, apart boolean").toArrow()
    lang = part.column("lang").to_pylist()
    names = sorted(set(lang))
    if not names:
        return Model(["und"], np.zeros((CELLS, 1)), np.zeros(1))
    label = np.array([names.index(x) for x in lang])
    cells, counts = (part.column(c).combine_chunks() for c in ("cells", "counts"))
    at, cell, times = cells.offsets.to_numpy(), cells.values.to_numpy(), counts.values.to_numpy()
    bags = Bags(at, cell, times)
    many = np.bincount(label)
    # a language of few rows needs them all to be learned from
    apart = np.array(part.column("apart").to_pylist(), bool) & (many[label] >= 40)
    if apart.all() or not apart.any():
        apart = np.arange(len(label)) % 4 == 3
    fitted = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(label))
    logit, bias = train(Chosen(bags, fitted), label[fitted], names)
    model = Model(names, logit.astype(np.float32), bias)
    held = np.flatnonzero(apart)
    if len(held):
        z = np.stack([(t @ logit[c] if len(c) else 0) + bias for c, t in (bags[i] for i in held)])
        y = label[held]
        grid = np.geomspace(0.05, 20, 61)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision)
        model.reject_below = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score, accepted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in batches:
            p = sent.value.scores(batch.column(1))
            letters = np.asarray(batch.column(2))
            names = np.array(sent.value.names, object)
            best = p.max(axis=1) if len(p) else np.zeros(0)
            lang = np.where(letters, names[p.argmax(axis=1)], "und") if len(p) else np.zeros(0, object)
            score = np.where(letters, best, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(letters & (score >= sent.value.reject_below))],
                names=["id", "lang", "score", "accepted"])
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(task, "id long, lang string, score double, accepted boolean")
