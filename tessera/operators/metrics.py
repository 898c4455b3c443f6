"""Evaluation metrics as single aggregate plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """``(n, rmse, mae, r2)`` in one pass (partial aggregates combine map-side).

    r2 = 1 - SSE / SST, with SST = sum(y^2) - n * mean(y)^2 so no second pass
    over the data is needed.
    """
    y = F.col(label).cast("double")
    e = F.col(prediction).cast("double") - y
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"),
                 F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return agg.select(
        F.col("n"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with prediction == label."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def residuals(df: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """Residual per row (label - prediction)."""
    return df.withColumn("residual", F.col(label).cast("double") - F.col(prediction).cast("double"))
