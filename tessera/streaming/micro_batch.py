"""Running the batch operators on streams.

here is a new operator: these helpers apply the existing DataFrame operators
to Structured Streaming inputs.

* :func:`stream_word_counts` is D1 as a stateful streaming aggregation (the
  state is one count per word, kept by Spark's state store and recovered from
  the checkpoint location after a failure).
* :func:`predict_pairs_stream` scores each micro-batch of incoming
  ``(user_id, item_id)`` pairs with C2 + C3 against a fixed training table,
  through ``foreachBatch`` (exactly-once when the sink is idempotent per
  batch id, as the parquet writes below are by batch folder).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.columns import default_when_missing
from tessera.operators.neighbors import knn_predict, lattice_neighbors
from tessera.operators.textstats import doc_tokens, word_freq


def stream_word_counts(docs_stream: DataFrame, clean: bool = True) -> DataFrame:
    """Streaming D1: running ``(word, n)`` over a stream of ``(doc_id, text)``.
    Start it with ``outputMode("update")`` or ``"complete"``."""
    return word_freq(doc_tokens(docs_stream, clean=clean))


def predict_pairs_stream(pairs_stream: DataFrame, train: DataFrame, out_path: str, checkpoint: str,
                         threshold: float = 1.5, user_fallback: bool = False, default: int = 1) -> StreamingQuery:
    """Nearest-neighbour rating prediction (C2 + C3) for each micro-batch of
    pairs; each batch is written to ``out_path/batch=<id>`` (overwrite, so a
    replayed batch replaces its own output).

    A pair without neighbours gets ``default``, so an answer depends on the pair
    and the training rows alone. With ``user_fallback`` it first takes the rating
    of the user's nearest neighbour, as the batch operator does; a stream only
    knows the user's pairs of the same micro-batch, so those answers depend on
    how the stream is cut.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        near = lattice_neighbors(train, batch, threshold)
        if user_fallback:
            pred = knn_predict(batch, near, default=default)
        else:
            best = near.groupBy(F.col("test_user").alias("user_id"), F.col("test_item").alias("item_id")) \
                .agg(F.min_by("rating", "offset_rank").alias("__r"))
            pred = batch.join(best, ["user_id", "item_id"], "left") \
                .withColumn("prediction", default_when_missing("__r", default=default).cast("int")).drop("__r")
        pred.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (pairs_stream.writeStream.foreachBatch(score)
            .option("checkpointLocation", checkpoint).start())
