import tempfile

from pyspark.sql import functions as F

from tessera.streaming.micro_batch import predict_pairs_stream, stream_word_counts


def test_stream_word_counts(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-")
    spark.createDataFrame([(1, "Red apples and red pears"), (2, "green apples")], "doc_id bigint, text string") \
        .write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(src + "/in")
    q = (stream_word_counts(stream).writeStream.outputMode("complete").format("memory")
         .queryName("wc_test").option("checkpointLocation", src + "/ck").start())
    q.processAllAvailable()
    q.stop()
    got = {r.word: r.n for r in spark.sql("SELECT * FROM wc_test").collect()}
    assert got == {"red": 2, "apples": 2, "pears": 1, "green": 1}


def test_predict_pairs_stream(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-")
    train = spark.createDataFrame([(1, 1, 4), (1, 3, 2)], "user_id bigint, item_id bigint, rating int")
    spark.createDataFrame([(1, 2), (9, 9)], "user_id bigint, item_id bigint").write.parquet(d + "/pairs")
    stream = spark.readStream.schema("user_id bigint, item_id bigint").parquet(d + "/pairs")
    q = predict_pairs_stream(stream, train, d + "/out", d + "/ck")
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.item_id): r.prediction for r in spark.read.parquet(d + "/out").collect()}
    assert got == {(1, 2): 4, (9, 9): 1}


def test_stream_answers_do_not_depend_on_its_cuts(spark, tmp_path):
    """The same pairs in one batch and in two; with the user fallback an answer may differ, as documented."""
    train = spark.createDataFrame([(1, 1, 4), (5, 5, 2)], "user_id bigint, item_id bigint, rating int")
    pairs = [(1, 2), (1, 90), (5, 6)]
    out = {}
    for name, cuts in (("one", [pairs]), ("two", [pairs[:1], pairs[1:]])):
        for k, part in enumerate(cuts):
            spark.createDataFrame(part, "user_id bigint, item_id bigint").coalesce(1).write.parquet(str(tmp_path / name / f"in{k}"))
        for fallback in (False, True):
            stream = spark.readStream.schema("user_id bigint, item_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in*"))
            at = str(tmp_path / f"{name}{fallback}")
            q = predict_pairs_stream(stream, train, at + "/out", at + "/ck", user_fallback=fallback)
            q.processAllAvailable()
            q.stop()
            out[name, fallback] = {(r.user_id, r.item_id): r.prediction for r in spark.read.parquet(at + "/out").collect()}
    assert out["one", False] == out["two", False] == {(1, 2): 4, (1, 90): 1, (5, 6): 2}
    assert out["one", True] == {(1, 2): 4, (1, 90): 4, (5, 6): 2} and out["two", True][1, 90] == 1
