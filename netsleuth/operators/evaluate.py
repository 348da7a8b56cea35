"""Evaluation.

Labels are 1 = anomaly, 0 = normal; scores are "higher = more normal", so
ranking metrics use ``-score`` as the anomaly score.  Ranking metrics group
by distinct score first and take running totals with ``global_prefix``, so
no single task ever sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.scalar import prediction_to_binary
from netsleuth.operators.sequence import global_prefix
from netsleuth.session import materialize

# Columns that may hold the label, the first present one counts.
LABEL_COLUMNS = ("prediction_g", "training_label", "label")


def ground_truth(stored: DataFrame, session: str | None = None) -> DataFrame:
    """P10: labelled training rows of one session with 0/1 label and the
    -1.0/0.0 pseudo-score."""
    d = stored.where(F.coalesce(F.col("training_mode"), F.lit(False)))
    if session is not None:
        d = d.where(F.col("training_session") == session)
    is_anom = F.coalesce(F.col("training_label") == K.LABEL_ANOMALY, F.lit(False))
    return (d.withColumn("anomaly_score_g", F.when(is_anom, -1.0).otherwise(0.0))
             .withColumn("prediction_g", is_anom.cast("int"))
             .withColumn("gt_label", F.col("prediction_g")))


def session_label_counts(gt: DataFrame) -> DataFrame:
    """Total / normal / anomaly rows per session."""
    lab = F.col("training_label")
    return gt.groupBy("training_session").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lab == K.LABEL_NORMAL).alias("normal"),
        F.count_if(lab == K.LABEL_ANOMALY).alias("anomaly"))


def as_binary(c) -> F.Column:
    """0/1 labels, or text labels ('anomaly' -> 1)."""
    col = F.col(c) if isinstance(c, str) else c
    txt = F.lower(F.trim(col.cast("string")))
    return F.when(txt == K.LABEL_ANOMALY, 1).when(txt == K.LABEL_NORMAL, 0).otherwise(col.try_cast("int"))


def join_scores(scores: DataFrame, gt: DataFrame, keys=("event_id",), score_col: str = "anomaly_score") -> DataFrame:
    """Inner join of scores and ground truth; ``gt_label`` from the
    priority column, ``prediction_bin`` 1 for predicted anomalies."""
    lab = next((c for c in LABEL_COLUMNS if c in gt.columns), None)                   # P11
    if lab is None:
        raise ValueError("ground truth has no label column")
    g = gt.select(*keys, as_binary(lab).alias("gt_label"))      # renamed before the join (Q9b)
    s = scores.drop("gt_label")
    out = s.join(g, list(keys), "inner")
    pred = prediction_to_binary("prediction") if "prediction" in s.columns else F.lit(0)
    return out.withColumn("prediction_bin", pred)


def outcome_counts(df: DataFrame, truth: str = "gt_label", pred: str = "prediction_bin") -> DataFrame:
    """One row with every count that A16-A18 need: ``tp{c}``, ``pp{c}`` and
    ``sup{c}`` (hits, predictions, support) of the classes 0 and 1, ``other``
    (rows whose label is neither; NULL labels are no class), ``agree`` and
    ``total``.  One aggregation of the joined rows."""
    y, p = F.col(truth), F.col(pred)
    aggs = [F.count_if(~y.isin(0, 1)).alias("other"), F.count_if(y == p).alias("agree"), F.count(F.lit(1)).alias("total")]
    for c in (0, 1):
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"pp{c}"), F.count_if(y == c).alias(f"sup{c}"),
                 F.count_if((y == c) & (p == 1 - c)).alias(f"miss{c}")]
    return df.agg(*aggs)


def confusion(df: DataFrame, truth: str = "gt_label", pred: str = "prediction_bin") -> DataFrame:
    """2x2 matrix as rows ``(gt_label, prediction, n)``, zero cells included."""
    return outcome_counts(df, truth, pred).select(
        F.expr("stack(4, 0, 0, tp0, 0, 1, miss0, 1, 0, miss1, 1, 1, tp1) AS (gt_label, prediction, n)"))


def _ratio(a, b) -> F.Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _class_metrics(c: int) -> dict[str, F.Column]:
    """Precision, recall and F1 of one class from ``outcome_counts``."""
    tp, pp, sup = F.col(f"tp{c}"), F.col(f"pp{c}"), F.col(f"sup{c}")
    return {"precision": _ratio(tp, pp), "recall": _ratio(tp, sup), "f1": _ratio(2 * tp, pp + sup)}


def _weighted(m: str) -> F.Column:
    zero, one = _class_metrics(0)[m], _class_metrics(1)[m]
    return _ratio(zero * F.col("sup0") + one * F.col("sup1"), F.col("sup0") + F.col("sup1"))


def prf(df: DataFrame, truth: str = "gt_label", pred: str = "prediction_bin") -> DataFrame:
    """Precision, recall, F1 with zero_division=0.  ``binary`` (class 1)
    when both labels 0 and 1 occur in the truth, else support-weighted."""
    both = (F.col("sup0") > 0) & (F.col("sup1") > 0) & (F.col("other") == 0)
    one = _class_metrics(1)
    return outcome_counts(df, truth, pred).select(
        *[F.when(both, one[m]).otherwise(_weighted(m)).alias(m) for m in ("precision", "recall", "f1")],
        F.when(both, "binary").otherwise("weighted").alias("average"))


def class_report(df: DataFrame, truth: str = "gt_label", pred: str = "prediction_bin") -> DataFrame:
    """Rows Normal, Anomaly, accuracy, macro avg, weighted avg."""
    none = F.lit(None).cast("double")
    support = F.col("sup0") + F.col("sup1")
    classes = [_class_metrics(c) for c in (0, 1)]
    metrics = ("precision", "recall", "f1")

    def line(name, values, n):
        return F.struct(F.lit(name).alias("class"), *[v.alias(m) for m, v in zip(metrics, values)], n.cast("long").alias("support"))
    lines = [line(n, [m[k] for k in metrics], F.col(f"sup{c}")) for c, (n, m) in enumerate(zip(("Normal", "Anomaly"), classes))]
    lines += [line("accuracy", [none, none, F.col("agree") / F.col("total")], F.col("total")),
              line("macro avg", [(classes[0][k] + classes[1][k]) / 2 for k in metrics], support),
              line("weighted avg", [_weighted(k) for k in metrics], support)]
    return outcome_counts(df, truth, pred).select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def score_counts(df: DataFrame, truth: str = "gt_label", score_col: str = "anomaly_score") -> DataFrame:
    """``(score, n, pos, neg)`` per distinct score, stored once: ranking
    metrics, quantiles and sweeps all read this table instead of the join.
    Rows without a 0/1 label count in ``n`` only."""
    y = F.col(truth)
    return materialize(df.groupBy(score_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def score_groups(df: DataFrame, truth: str = "gt_label", score_col: str = "anomaly_score") -> DataFrame:
    """Per distinct score, positives and negatives, with inclusive running
    totals in ascending score (= descending anomaly score).  ``df`` may be a
    ``score_counts`` table."""
    g = df if {"pos", "neg"} <= set(df.columns) else score_counts(df, truth, score_col)
    return global_prefix(g.where("pos + neg > 0"), score_col, ["pos", "neg"])


def roc_auc_ap(df: DataFrame, truth: str = "gt_label", score_col: str = "anomaly_score") -> DataFrame:
    """A19 ROC-AUC (ties count one half) and A20 average precision
    sum_n (R_n - R_{n-1}) P_n of the anomaly score ``-score``.  One row."""
    t = score_counts(df, truth, score_col)
    g = score_groups(t, truth, score_col)
    Pd, Nd = (t.agg(F.sum(c)).scalar().cast("double") for c in ("pos", "neg"))
    auc = F.sum(F.col("pos") * (Nd - F.col("_cum_neg") + 0.5 * F.col("neg"))) / (Pd * Nd)
    prec = F.col("_cum_pos").cast("double") / (F.col("_cum_pos") + F.col("_cum_neg"))
    ap = F.sum(F.col("pos") / Pd * prec)
    return g.agg(auc.alias("roc_auc"), ap.alias("average_precision"))


def pr_curve(df: DataFrame, truth: str = "gt_label", score_col: str = "anomaly_score") -> DataFrame:
    """One point per distinct score: predicting anomalies for
    ``score <= threshold`` gives this precision and recall."""
    t = score_counts(df, truth, score_col)
    g = score_groups(t, truth, score_col)
    P = t.agg(F.sum("pos")).scalar().cast("double")
    tp, fp = F.col("_cum_pos").cast("double"), F.col("_cum_neg").cast("double")
    return g.select(F.col(score_col).alias("threshold"), F.col("_cum_pos").alias("tp"), F.col("_cum_neg").alias("fp"),
                    (tp / (tp + fp)).alias("precision"),
                    F.coalesce(tp / F.nullif(P, F.lit(0.0)), F.lit(0.0)).alias("recall"))


def fn_fp(df: DataFrame, thr: float, truth: str = "gt_label", score_col: str = "anomaly_score") -> tuple:
    """M8: false negatives and false positives at ``thr`` (labels 0/1 or text)."""
    y = as_binary(truth)
    pred = F.col(score_col) < F.lit(thr)
    return df.where((y == 1) & ~pred), df.where((y == 0) & pred)


def fn_fp_samples(df: DataFrame, thr: float, n: int = 20, truth: str = "gt_label",
                  score_col: str = "anomaly_score", tie: str = "event_id") -> DataFrame:
    """L3: the ``n`` worst misses: false negatives with the highest score and
    false positives with the lowest (top-k, no full sort)."""
    fn, fp = fn_fp(df, thr, truth, score_col)
    a = fn.orderBy(F.col(score_col).desc(), F.col(tie).asc()).limit(n).withColumn("kind", F.lit("fn"))
    b = fp.orderBy(F.col(score_col).asc(), F.col(tie).asc()).limit(n).withColumn("kind", F.lit("fp"))
    return a.unionByName(b)


def profile(df: DataFrame, kind: str, proto_col: str = "proto", port_col: str = "dest_port",
            top: int = 3) -> tuple:
    """A23 top protocols and A24 port distribution of a FN or FP set."""
    protos = (df.groupBy(proto_col).agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.col("n").desc(), F.col(proto_col).asc()).limit(top)
                .withColumn("kind", F.lit(kind)))
    p = F.col(port_col).cast("double")
    desc = df.agg(F.lit(kind).alias("kind"), F.count(p).alias("count"), F.avg(p).alias("mean"),
                  F.stddev_samp(p).alias("std"), F.min(p).alias("min"),
                  F.percentile(p, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("_q"),
                  F.max(p).alias("max"))
    desc = desc.select("kind", "count", "mean", "std", "min", F.col("_q")[0].alias("p50"),
                       F.col("_q")[1].alias("p90"), F.col("_q")[2].alias("p99"), "max")
    return protos, desc


def value_counts(df: DataFrame, col: str, kind: str | None = None) -> DataFrame:
    """Value counts of one column as ``(kind, value, n)``."""
    return df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) \
             .withColumn("kind", F.lit(kind or col)).select("kind", "value", "n")
