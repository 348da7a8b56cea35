"""Thresholds.

Scores are "higher = more normal"; a row is predicted anomalous when
``score < threshold``.  A sweep costs one exact quantile pass (all grid
quantiles at once) and one scan that drops every row into its grid bucket;
the metrics of every threshold then come from running totals over at most
``steps + 1`` bucket rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.scalar import prediction_label, prediction_to_binary
from netsleuth.operators.evaluate import score_counts
from netsleuth.operators.scaling import quantiles


def grid_probs(lo: float, hi: float, steps: int) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, steps)]


def grid_thresholds(df: DataFrame, score_col: str, grid=K.MIN_PRECISION_GRID, weight: str | None = None) -> list[float]:
    """Distinct sorted score quantiles at ``linspace(lo, hi, steps)``."""
    q = quantiles(df, [score_col], grid_probs(*grid), weight)[score_col]
    return sorted(set(float(x) for x in q if x is not None))


def quantile_threshold(df: DataFrame, score_col: str, q: float, weight: str | None = None) -> float | None:
    return quantiles(df, [score_col], [q], weight)[score_col][0]


def label_by_threshold(df: DataFrame, thr: float, score_col: str = "anomaly_score") -> DataFrame:
    """Prediction -1/1, binary flag and text label at ``thr``."""
    pred = F.when(F.col(score_col) < F.lit(thr), K.ANOMALY_PREDICTION).otherwise(K.NORMAL_PREDICTION)
    return (df.withColumn("threshold", F.lit(thr))
              .withColumn("prediction", pred)
              .withColumn("is_anomaly", prediction_to_binary("prediction"))
              .withColumn("label", prediction_label("prediction")))


def sweep_table(df: DataFrame, thresholds: list[float], truth_col: str, score_col: str) -> DataFrame:
    """Metrics at every threshold: ``(threshold, tp, fp, fn, precision, recall, f1)``.

    ``df`` holds rows, or ``score_counts`` of them.  One scan: each row's bucket is the number of thresholds <= its score, so
    it is predicted anomalous exactly for thresholds with index >= bucket.
    """
    spark = df.sparkSession
    tarr = F.array(*[F.lit(float(t)) for t in thresholds]) if thresholds else F.array().cast("array<double>")
    if {"pos", "neg"} <= set(df.columns):
        pos, neg = F.col("pos"), F.col("neg")
    else:
        y = F.col(truth_col).cast("int")
        pos, neg = (F.coalesce(y == c, F.lit(False)).cast("int") for c in (1, 0))
    buckets = (df.select(F.size(F.filter(tarr, lambda t: t <= F.col(score_col))).alias("i"), pos.alias("pos"), neg.alias("neg"))
                 .groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    grid = spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "i int, threshold double")
    total_pos = buckets.agg(F.sum("pos")).scalar()          # scalar subquery
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # <= steps rows
    t = (grid.join(buckets, "i", "left").fillna(0, ["pos", "neg"])
             .withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
             .withColumn("P", F.coalesce(total_pos, F.lit(0))))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn = F.col("P").cast("double") - tp
    return t.select(
        "i", "threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0.0)), F.lit(0.0)).alias("precision"),
        F.coalesce(tp / F.nullif(F.col("P").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("recall"),
        F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def best_threshold(df: DataFrame, truth_col: str = "gt_label", score_col: str = "anomaly_score",
                   grid=K.MIN_PRECISION_GRID, min_precision: float | None = K.MIN_PRECISION_FOR_THRESHOLD,
                   fallback_quantile: float = K.LOW_TAIL_PERCENTILE) -> DataFrame:
    """M6 (no floor) / M7 (precision floor): the grid threshold with the best
    F1, lowest threshold on ties (L6).  When no threshold meets the floor, the
    ``fallback_quantile`` of the scores with zero metrics.  One row:
    ``(threshold, precision, recall, f1)``."""
    counts = score_counts(df, truth_col, score_col)
    ths = grid_thresholds(counts, score_col, grid, "n")
    table = sweep_table(counts, ths, truth_col, score_col)
    if min_precision is not None:
        table = table.where(F.col("precision") >= F.lit(min_precision))
    best = table.orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1) \
                .select("threshold", "precision", "recall", "f1")
    row = best.first()
    spark = df.sparkSession
    if row is None:
        thr = quantile_threshold(counts, score_col, fallback_quantile, "n")
        return spark.createDataFrame([(thr, 0.0, 0.0, 0.0)], "threshold double, precision double, recall double, f1 double")
    return spark.createDataFrame([tuple(row)], "threshold double, precision double, recall double, f1 double")
