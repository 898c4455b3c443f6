"""Toxicity by class-conditional Kneser-Ney models.

Two models of order four over the letters' bytes (A-Z folded, runs of anything
else one blank), one of toxic and one of ordinary texts, share their backoff:
below the class's four-byte counts stand continuation counts (distinct left
neighbours) of both classes together, down to single bytes. An expression
counts once a text in the counts, so repeated words and lines don't weigh more.
A text's score compares the log-likelihoods under both models, normalised by
length, of every stretch of ``STRETCH`` letters and takes the most toxic one (a
shorter text is one stretch): a few toxic words tell in a text of any length.
It is calibrated on labelled rows that the counts leave out at first.

The discount is the same relative frequency in both classes, so an expression
that is rare backs off in both and cancels: ``discount`` texts in the smaller
class, at every size, and as many times more in the larger one as that has more
counts. Every expression above it keeps evidence of its own. The tables are
aggregated by Spark, stay in a written table and are sent to the tasks in
slices of at most about ``SLICE`` expressions. A task that meets more than one
slice holds one at a time, so memory doesn't grow with their number.

Nulls and ties: a null or empty text, or one without letters, has ratio 0.
Of repeated labels of one id the larger holds. Without labels of both classes
every score is the calibrated base rate. An empty table gives no rows.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.labelled import draw, labelled_texts, learning_labels, platt, sigmoid
from tessera.llm.shared import forget, written
from tessera.llm.textarrays import LETTERS, chunks, ragged, release

ORDER = 4          # bytes of an expression
STRETCH = 32       # letters a likelihood is compared over
LOWER = 0.75       # discount of the shared continuation counts
BLANK = 0x20
SLICE = 1 << 22    # expressions sent to the tasks in one table (12 bytes each, contexts besides)


def letter_stream(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text index) with A-Z folded and each run of other bytes as one blank."""
    fold = np.where(LETTERS, np.arange(256), BLANK)
    fold[65:91] += 32
    b = fold.astype(np.uint8)[buf]
    blank = b == BLANK
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return b[at], np.searchsorted(off, at, "right") - 1


def in_order(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed last ORDER bytes, text index) of every place of each text.

    The newest byte is the lowest; a text is preceded by blanks.
    """
    if not len(buf):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b, doc = letter_stream(buf, off)
    packed = np.zeros(len(b), np.uint32)
    for i in range(ORDER):
        back = np.full(len(b), BLANK, np.uint32)
        back[i:] = b[:max(len(b) - i, 0)]
        if i:
            back[i:][doc[i:] != doc[:-i]] = BLANK
        packed |= back << np.uint32(8 * i)
    return packed, doc


def expressions(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed last ORDER bytes, text index) of every distinct expression of each text."""
    packed, doc = in_order(buf, off)
    packed = np.unique((doc.astype(np.uint64) << np.uint64(8 * ORDER)) | packed)
    return (packed & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64), (packed >> np.uint64(8 * ORDER)).astype(np.int64)


def counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): texts of each class with an expression, over all rows (id, text, label)."""
    def task(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, j, buf, off in chunks(batch.column(0)):
                gram, doc = expressions(buf, off)
                u, back = np.unique(gram, return_inverse=True)
                toxic = np.bincount(back, label[i:j][doc], minlength=len(u)).astype(np.int64)
                ordinary = np.bincount(back, minlength=len(u)) - toxic
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(toxic), pa.array(ordinary)],
                                                 names=["gram", "toxic", "ordinary"])
    part = rows.select("text", F.col("label").cast("long").alias("label")).mapInArrow(task, "gram long, toxic long, ordinary long")
    return part.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Slice:
    """Log ratios (toxic - ordinary) of expressions with evidence, and of contexts' backoff weights;
    expressions from ``first`` up to ``end``."""
    first: int
    end: int
    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray

    def of(self, gram: np.ndarray) -> np.ndarray:
        """Log ratio of every expression."""
        at, known = find(self.contexts, (gram >> 8).astype(np.uint32))
        r = np.where(known, self.backoff[at], 0.0)
        at, known = find(self.grams, gram.astype(np.uint32))
        return np.where(known, self.ratio[at], r)


@dataclass
class Model:
    """Slices (broadcast) that cover all expressions, and the calibration."""
    slices: list
    slope: float = 1.0
    offset: float = 0.0

    def ratios(self, column) -> np.ndarray:
        """Log-likelihood ratio a letter of the most toxic stretch of every text."""
        if len(self.slices) == 1:
            of = self.slices[0].value.of
        else:
            known = [np.unique(in_order(buf, off)[0]) for _, _, buf, off in chunks(column)] if self.slices else []
            known = np.unique(np.concatenate(known)).astype(np.int64) if known else np.zeros(0, np.int64)
            found = np.zeros(len(known))
            for sent in self.slices:
                part = sent.value
                mine = slice(*np.searchsorted(known, [part.first, part.end]))
                found[mine] = part.of(known[mine])
                unload(sent)

            def of(gram):
                return found[np.searchsorted(known, gram)] if len(known) else np.zeros(len(gram))
        out = []
        for i, j, buf, off in chunks(column):
            gram, doc = in_order(buf, off)
            u, back = np.unique(gram, return_inverse=True)
            out.append(most_toxic(of(u.astype(np.int64))[back], doc, j - i))
        return np.concatenate(out) if out else np.zeros(0)


def most_toxic(ratio: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The largest mean of ``STRETCH`` neighbouring ratios of each of ``n`` texts, of all if a text has fewer, 0 if none."""
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    first, last = (np.searchsorted(doc, np.arange(n), side) for side in ("left", "right"))
    size = last - first
    out = (sums[last] - sums[first]) / np.maximum(size, 1)
    long = np.flatnonzero(size > STRETCH)
    if len(long):
        per = size[long] - STRETCH + 1
        at = ragged(first[long], per)
        out[long] = np.maximum.reduceat((sums[at + STRETCH] - sums[at]) / STRETCH, np.cumsum(per) - per)
    return out


def unload(sent):
    """Let a task drop a broadcast value; it is read again from the executor's file when asked for."""
    if getattr(sent, "_path", None) is not None and TaskContext.get() is not None:
        sent.__dict__.pop("_value", None)


def find(keys: np.ndarray, of: np.ndarray):
    """(index, whether it is there) of values in sorted keys."""
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(tail, p): Kneser-Ney probability of the newest byte after the ORDER - 2 bytes before it,
    from the distinct left neighbours of both classes' expressions."""
    levels, rows = [], grams.select(F.col("gram").alias("tail"))
    for order in range(ORDER - 1, 0, -1):
        rows = rows.groupBy(F.col("tail").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("tail")).agg(F.count(F.lit(1)).alias("c"))
        levels.append((order, rows))
    below = None
    for order, rows in reversed(levels):
        context = Window.partitionBy(F.shiftrightunsigned("tail", 8))
        rows = (rows.withColumn("all", F.sum("c").over(context)).withColumn("kinds", F.count(F.lit(1)).over(context)))
        if below is None:
            rows = rows.withColumn("low", F.lit(1 / 256))
        else:
            rows = rows.withColumn("short", F.col("tail").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))) \
                .join(below.select(F.col("tail").alias("short"), F.col("p").alias("low")), "short")
        below = rows.select("tail", (F.greatest(F.col("c") - LOWER, F.lit(0.0)) / F.col("all")
                                     + LOWER * F.col("kinds") / F.col("all") * F.col("low")).alias("p"))
    return below


def fit_counts(rows: DataFrame, discount: float = 0.75) -> Model:
    """The models from all rows (id, text, label)."""
    grams = written(counts(rows), "expressions")
    model = from_counts(grams, discount)
    forget(grams)
    return model


def from_counts(grams: DataFrame, discount: float) -> Model:
    """The models from a written table of counts (gram, toxic, ordinary)."""
    total = grams.agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")).first()
    nt, no = float(total["t"] or 0), float(total["o"] or 0)
    if not nt or not no:
        return Model([])
    dt, do = discount * nt / min(nt, no), discount * no / min(nt, no)
    context = Window.partitionBy(F.shiftrightunsigned("gram", 8))
    seen = grams
    for side, d in (("toxic", dt), ("ordinary", do)):
        over = F.greatest(F.col(side) - F.lit(d), F.lit(0.0))
        all_ = F.sum(side).over(context)
        seen = (seen.withColumn(f"p_{side}", F.when(all_ > 0, over / all_).otherwise(0.0))
                .withColumn(f"back_{side}", F.when(all_ > 0, F.greatest(1 - F.sum(over).over(context) / all_, F.lit(1e-4))).otherwise(1.0)))
    kept = seen.filter((F.col("p_toxic") > 0) | (F.col("p_ordinary") > 0)) \
        .withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))).join(shared_backoff(grams), "tail")
    kept = written(kept.select("gram", "p_toxic", "p_ordinary", "back_toxic", "back_ordinary", "p"), "evidence")
    model = Model([grams.sparkSession.sparkContext.broadcast(part(kept, lo, hi)) for lo, hi in ranges(kept)])
    forget(kept)
    return model


def ranges(kept: DataFrame) -> list[tuple[int, int]]:
    """Neighbouring ranges of expressions with at most about ``SLICE`` rows each; a context is in one of them."""
    step = 8 * (ORDER - 2)   # no more than 2^16 groups
    sizes = sorted(kept.groupBy(F.shiftrightunsigned("gram", step).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect())
    cuts, held = [0], 0
    for g, n in sizes:
        if held and held + n > SLICE:
            cuts.append(g << step)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], 1 << 8 * ORDER])) if sizes else []


def part(kept: DataFrame, lo: int, hi: int) -> Slice:
    found = kept.filter((F.col("gram") >= lo) & (F.col("gram") < hi)).toArrow()
    order = np.argsort(found.column("gram").to_numpy())
    gram, pt, po, bt, bo, p = (found.column(c).to_numpy()[order] for c in found.column_names)
    contexts, first = np.unique(gram >> 8, return_index=True)
    return Slice(lo, hi, gram.astype(np.uint32), np.log(pt + bt * p) - np.log(po + bo * p), contexts.astype(np.uint32),
                 (np.log(bt) - np.log(bo))[first])


def fit(docs: DataFrame, labels: DataFrame, held_out, label_col: str = "toxic", calibration: float = 0.2,
        calibration_rows: int = 20000, discount: float = 0.75, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Model and calibration from the labelled documents that ``held_out`` doesn't hold back.

    A fraction ``calibration`` of the labelled rows is left out of the counts at first; at most about
    ``calibration_rows`` of those, chosen by their ids, calibrate the scores. Then their counts are added,
    so the final tables count every labelled row.
    """
    known = learning_labels(labels, label_col, held_out, id_col)
    rows = written(labelled_texts(docs, known, id_col, text_col), "labelled")
    apart = draw("calibration") < calibration
    first = written(counts(rows.filter(~apart)), "expressions")
    model = from_counts(first, discount)
    n = rows.filter(apart).count()
    sample = rows.filter(apart & (draw("sample") <= min(1.0, calibration_rows / max(n, 1))))

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.ratios(batch.column(0))), batch.column(1)], names=["ratio", "label"])
    seen = sample.select("text", "label").mapInArrow(task, "ratio double, label int").toPandas()
    slope, offset = platt(seen["ratio"].to_numpy(float), seen["label"].to_numpy())
    for sent in model.slices:
        sent.unpersist()
    every = first.unionByName(counts(rows.filter(apart))).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    every = written(every, "expressions")
    model = from_counts(every, discount)
    model.slope, model.offset = slope, offset
    forget(first, every, rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ratio, score) of every row: log-likelihood ratio a letter of the most toxic stretch and calibrated probability of toxic."""
    def task(batches):
        for batch in batches:
            r = model.ratios(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r), pa.array(sigmoid(model.slope * r + model.offset))],
                                             names=["id", "ratio", "score"])
        release()
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(task, "id long, ratio double, score double")


def keep_clean(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with all their columns."""
    def task(batches):
        for batch in batches:
            r = model.ratios(batch.column(text_col))
            yield batch.filter(pa.array(sigmoid(model.slope * r + model.offset) < least))
        release()
    return docs.mapInArrow(task, docs.schema)
