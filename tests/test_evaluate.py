"""Reports with true costs, rounded CSV, cosine sets, Euclidean distance."""
import numpy as np
from pyspark.sql import functions as F

from tessera.functions.columns import euclidean
from tessera.operators import content, evaluate
from tessera.operators.metrics import regression_metrics
from tessera.sources import sinks


def test_report_runs_each_prediction_once(spark, tmp_path):
    """Metrics come from the rows of the one pass that is timed and written."""
    rows = spark.range(200).select("id", (F.col("id") % 5 + 1).cast("int").alias("rating"))
    runs = spark.sparkContext.accumulator(0)

    def count(it):
        for f in it:
            runs.add(len(f))
            yield f
    methods = {"plus": evaluate.Method(lambda: rows, lambda m: m.withColumn("prediction", F.col("rating") + F.lit(0.5)).mapInPandas(count, "id long, rating int, prediction double"),
                                       force=lambda m: [m], describe=lambda m: [("coefficient", "x", 2.0)])}
    got = {(r.metric, r.item): r.value for r in evaluate.evaluated(spark, methods, str(tmp_path)).collect()}
    assert runs.value == 200 and spark.read.parquet(f"{tmp_path}/plus").count() == 200
    want = regression_metrics(spark.read.parquet(f"{tmp_path}/plus"), "rating", "prediction").first()
    assert got["coefficient", "x"] == 2.0 and got["n", ""] == 200 and got["fit_seconds", ""] > 0 and got["predict_seconds", ""] > 0
    assert all(abs(got[k, ""] - want[k]) < 1e-9 for k in ("rmse", "mae", "r2"))
    folds = spark.createDataFrame([(0, 10, 1.0, 0.5), (1, 10, 2.0, 1.5)], "fold int, n long, rmse double, mae double")
    assert evaluate.describe_folds(folds)[-2:] == [("cv_rmse", "mean", 1.5), ("cv_mae", "mean", 1.0)]


def test_csv_is_rounded(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, 3.49), (4, None)], "id int, prediction double").coalesce(1)
    sinks.write_csv(df.orderBy("id"), str(tmp_path / "c"), digits=0)
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text.split() == ["1,2.0", "2,4.0", "3,3.0", '4,""'] or text.split() == ["1,2.0", "2,4.0", "3,3.0", "4,"]


def test_column_cosines(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((30, 12)) < 0.2) * rng.integers(1, 6, (30, 12))
    x[0] = 1
    x[1:, 4] = 0
    df = spark.createDataFrame([(int(u), int(i), int(x[u, i])) for u, i in zip(*np.nonzero(x))], "user_id long, item_id long, rating int")
    got = content.column_cosines(df, spark.createDataFrame([(3,), (4,), (99,)], "q long"), 6).collect()
    size = np.sqrt((x * x).sum(0))
    want = []
    for q in (3, 4):
        s = (x[:, q] @ x) / (size[q] * size)
        want += [(q, i, r + 1, round(s[i], 9)) for r, i in enumerate(sorted((i for i in range(12) if i != q), key=lambda i: (-s[i], i))[:6])]
    assert sorted((r.query, r.item_id, r.rank, round(r.score, 9)) for r in got) == sorted(want)


def test_euclidean(spark):
    rows = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [3.0, -4.0]), (3, [1.0, 0.0]), (4, None), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>")
    assert [r[0] for r in df.filter("item_id < 2").select(euclidean("vec", F.array(F.lit(3.0), F.lit(4.0)))).collect()] == [5.0, 0.0]
    got = content.nearest_euclidean(df, "item_id", 0, 3).collect()
    assert [(r.item_id, r.dist, r["rank"]) for r in got] == [(3, 1.0, 1), (1, 5.0, 2), (2, 5.0, 3)]
    assert content.nearest_euclidean(df, "item_id", 77, 3).count() == 0
