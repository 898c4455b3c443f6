"""Binary-feature naive Bayes over word presence.

Model (add-0.5 smoothing, two bins per feature):
  prior(c)   = (N_c + 0.5) / (N + 0.5 * C)
  theta(c,w) = (n_cw + 0.5) / (N_c + 1)           P(word present | c)
  score(d,c) = log prior(c) + sum_vocab log(1 - theta) + sum_{w in d} (log theta - log(1 - theta))

Everything is aggregates and joins. The vocabulary (``vocab_size`` words) and
the class x vocabulary table are bounded by the parameters, so they are the
only sides broadcast; documents are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import explode_terms
from tessera.operators.textstats import most_common, word_freq

MAX_CLASSES = 10_000
BROADCAST_ROWS = 200_000


def vocabulary(clean_tokens: DataFrame, size: int = 2000, col: str = "tokens") -> DataFrame:
    """The ``size`` most frequent cleaned words, ``(rank, word, n)``."""
    return most_common(word_freq(clean_tokens, col), size)


def presence(doc_words: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", col: str = "tokens",
             keep: list[str] | None = None) -> DataFrame:
    """Sparse presence features ``(doc_id, [keep...], word)``: one row per
    vocabulary word present in the document (absent words are implicit)."""
    words = explode_terms(doc_words, F.array_distinct(col), "word", doc_id, *(keep or []))
    return words.join(F.broadcast(vocab.select("word")), "word").select(doc_id, *(keep or []), "word")


@dataclass
class NBModel:
    classes: list
    class_stats: DataFrame   # (label, n_docs, prior, log_prior, sum_log_absent)
    theta: DataFrame         # (label, word, n_cw, theta, log_t, log_f)
    vocab_size: int


def class_word_counts(present: DataFrame, label: str = "label") -> DataFrame:
    """Documents of each class containing each word, ``(label, word, n_cw)``."""
    return present.groupBy(label, "word").agg(F.count(F.lit(1)).alias("n_cw"))


def fit_nb(present: DataFrame, labelled_docs: DataFrame, vocab: DataFrame, smoothing: float = 0.5,
           label: str = "label", doc_id: str = "doc_id") -> NBModel:
    """Train on presence rows of the training documents.

    ``labelled_docs`` is ``(doc_id, label)`` of the training documents.
    The class list is collected; more than ``MAX_CLASSES`` classes raise.
    """
    per_class = labelled_docs.groupBy(label).agg(F.count(F.lit(1)).alias("n_docs"))
    classes = sorted(r[0] for r in per_class.select(label).limit(MAX_CLASSES + 1).collect())
    n_classes = len(classes)
    if n_classes > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    vocab_size = vocab.count()
    counts = class_word_counts(present, label)
    total = F.sum("n_docs").over(Window.partitionBy(F.lit(0)))
    stats = (per_class
             .withColumn("prior", (F.col("n_docs") + smoothing) / (total + smoothing * n_classes))
             .withColumn("log_prior", F.log("prior")))
    # class x vocabulary grid from an exploded literal class list (bounded: C x V rows)
    grid = vocab.select("word", F.explode(F.array(*[F.lit(c) for c in classes])).alias(label))
    theta = (grid.join(counts, [label, "word"], "left")
             .join(F.broadcast(stats.select(label, "n_docs")), label)
             .withColumn("n_cw", F.coalesce("n_cw", F.lit(0)).cast("bigint"))
             .withColumn("theta", (F.col("n_cw") + smoothing) / (F.col("n_docs") + 2 * smoothing))
             .withColumn("log_t", F.log("theta"))
             .withColumn("log_f", F.log(1 - F.col("theta")))
             .select(label, "word", "n_cw", "theta", "log_t", "log_f"))
    absent = theta.groupBy(label).agg(F.sum("log_f").alias("sum_log_absent"))
    stats = stats.join(absent, label)
    return NBModel(classes, stats, theta, vocab_size)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` broadcast if its known number of rows is small; else Spark chooses."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def nb_scores(model: NBModel, present: DataFrame, docs: DataFrame, label: str = "label",
              doc_id: str = "doc_id") -> DataFrame:
    """Log score per ``(doc_id, label)`` for the documents in ``docs``."""
    base = (docs.select(doc_id, F.explode(F.array(*[F.lit(c) for c in model.classes])).alias(label))
            .join(F.broadcast(model.class_stats.select(label, (F.col("log_prior") + F.col("sum_log_absent"))
                                                       .alias("base"))), label))
    delta = (present.select(doc_id, "word")
             .join(_sent(model.theta.select(label, "word", (F.col("log_t") - F.col("log_f")).alias("d")), len(model.classes) * model.vocab_size),
                   "word")
             .groupBy(doc_id, label).agg(F.sum("d").alias("d")))
    return (base.join(delta, [doc_id, label], "left")
            .select(doc_id, label, (F.col("base") + F.coalesce("d", F.lit(0.0))).alias("score")))


def predict_nb(model: NBModel, present: DataFrame, docs: DataFrame, label: str = "label",
               doc_id: str = "doc_id") -> DataFrame:
    """J15 + J16: ``(doc_id, prediction, p_<class>...)``; probabilities are the
    softmax of the log scores, the prediction their argmax (ties: smaller class)."""
    s = nb_scores(model, present, docs, label, doc_id)
    agg = s.groupBy(doc_id).agg(
        F.max("score").alias("m"),
        F.min(F.struct((-F.col("score")).alias("s"), F.col(label).alias("c")))
        .alias("best"),
        *[F.max(F.when(F.col(label) == c, F.col("score"))).alias(f"s_{c}") for c in model.classes])
    denom = sum((F.exp(F.col(f"s_{c}") - F.col("m")) for c in model.classes), F.lit(0.0))
    return agg.select(doc_id, F.col("best.c").alias("prediction"),
                      *[(F.exp(F.col(f"s_{c}") - F.col("m")) / denom).alias(f"p_{c}") for c in model.classes])


def informative_features(model: NBModel, n: int = 10, label: str = "label") -> DataFrame:
    """``(word, present, ratio, label_max)``: per word and value, the
    likelihood ratio max_c / min_c of P(value | c), highest first, top ``n``."""
    t = model.theta
    per_val = t.select("word", label, F.lit(True).alias("present"), F.col("theta").alias("p")).unionByName(
        t.select("word", label, F.lit(False).alias("present"), (1 - F.col("theta")).alias("p")))
    agg = per_val.groupBy("word", "present").agg(
        (F.max("p") / F.min("p")).alias("ratio"),
        F.min(F.struct((-F.col("p")).alias("s"), F.col(label).alias("c")))
        .alias("best"))
    return (agg.select("word", "present", "ratio", F.col("best.c").alias("label_max"))
            .orderBy(F.desc("ratio"), F.asc("word"), F.desc("present")).limit(n))
