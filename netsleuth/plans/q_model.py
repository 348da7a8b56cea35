"""Scaling, thresholds and evaluation queries over the flow view with its
deterministic stand-in score (higher = more normal)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.operators import evaluate as EV
from netsleuth.operators import scaling as SC
from netsleuth.operators import thresholds as TH
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.registry import register
from netsleuth.sources.flowview import flows, with_model_prediction

SESSION = "session-a"
PCT = K.LOW_TAIL_PERCENTILE
F1_GRID = K.F1_SWEEP_GRID
MP_GRID = K.MIN_PRECISION_GRID


def _grid_sql(lo, hi, steps):
    return "[" + ", ".join(repr(p) + "::DOUBLE" for p in TH.grid_probs(lo, hi, steps)) + "]"


EVAL_CTE = """
gt AS (SELECT event_id, training_label, CASE WHEN training_label = 'anomaly' THEN -1.0 ELSE 0.0 END AS anomaly_score_g,
              CASE WHEN training_label = 'anomaly' THEN 1 ELSE 0 END AS prediction_g
       FROM flow WHERE training_mode AND training_session = 'session-a'),
j AS (SELECT s.event_id, s.anomaly_score, s.proto, s.dest_port, g.prediction_g AS gt_label,
             CASE WHEN s.prediction = -1 THEN 1 ELSE 0 END AS prediction_bin
      FROM scored s JOIN gt g USING (event_id))
"""


def _sweep_sql(grid, min_precision, fallback_q):
    """Independent sweep: every grid threshold crossed with every row."""
    floor = f"WHERE precision >= {min_precision}" if min_precision is not None else ""
    return f"""
th AS (SELECT DISTINCT unnest(quantile_cont(anomaly_score, {_grid_sql(*grid)})) AS threshold FROM j),
ev AS (SELECT th.threshold,
              sum(CASE WHEN j.anomaly_score < th.threshold AND j.gt_label = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
              sum(CASE WHEN j.anomaly_score < th.threshold AND j.gt_label = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
              sum(CASE WHEN j.anomaly_score >= th.threshold AND j.gt_label = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn
       FROM th CROSS JOIN j GROUP BY th.threshold),
m AS (SELECT threshold,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM ev),
best AS (SELECT threshold, precision, recall, f1 FROM m {floor} ORDER BY f1 DESC, threshold ASC LIMIT 1),
sel AS (SELECT * FROM best
        UNION ALL
        SELECT (SELECT quantile_cont(anomaly_score, {fallback_q}) FROM j), 0.0, 0.0, 0.0
        WHERE NOT EXISTS (SELECT 1 FROM best))
"""


def _scored(spark, sf_dir):
    return with_model_prediction(flows(spark, sf_dir))


def _joined(spark, sf_dir):
    s = _scored(spark, sf_dir).select("event_id", "anomaly_score", "prediction", "proto", "dest_port")
    gt = EV.ground_truth(flows(spark, sf_dir), SESSION).select("event_id", "prediction_g", "training_label")
    return EV.join_scores(s, gt)


@register("ground_truth", "S5,P10", with_flow("""
SELECT event_id, training_label, anomaly_score_g, prediction_g, prediction_g AS gt_label FROM gt""", EVAL_CTE))
def ground_truth(spark, sf_dir):
    return EV.ground_truth(flows(spark, sf_dir), SESSION).select(
        "event_id", "training_label", "anomaly_score_g", "prediction_g", "gt_label")


@register("session_label_counts", "A12,A11", with_flow("""
SELECT training_session, count(*) AS total, count(*) FILTER (WHERE training_label = 'normal') AS normal,
       count(*) FILTER (WHERE training_label = 'anomaly') AS anomaly
FROM flow WHERE training_mode GROUP BY training_session"""))
def session_label_counts(spark, sf_dir):
    f = flows(spark, sf_dir).where("training_mode")
    return EV.session_label_counts(f)


@register("score_gt_join", "J5,P11,F19", with_flow("""
SELECT event_id, anomaly_score, prediction_bin, gt_label FROM j""", EVAL_CTE))
def score_gt_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("event_id", "anomaly_score", "prediction_bin", "gt_label")


@register("confusion_matrix", "A16", with_flow("""
SELECT y.gt_label, p.prediction, (SELECT count(*) FROM j WHERE j.gt_label = y.gt_label AND j.prediction_bin = p.prediction) AS n
FROM (VALUES (0), (1)) y(gt_label) CROSS JOIN (VALUES (0), (1)) p(prediction)""", EVAL_CTE))
def confusion_matrix(spark, sf_dir):
    return EV.confusion(_joined(spark, sf_dir))


@register("prf_metrics", "A17", with_flow("""
SELECT CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, 'binary' AS average
FROM (SELECT count(*) FILTER (WHERE gt_label = 1 AND prediction_bin = 1)::DOUBLE AS tp,
             count(*) FILTER (WHERE gt_label = 0 AND prediction_bin = 1)::DOUBLE AS fp,
             count(*) FILTER (WHERE gt_label = 1 AND prediction_bin = 0)::DOUBLE AS fn FROM j)""", EVAL_CTE))
def prf_metrics(spark, sf_dir):
    return EV.prf(_joined(spark, sf_dir))


@register("class_report", "A18", with_flow("""
SELECT class, precision, recall, f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg(CASE WHEN gt_label = prediction_bin THEN 1.0 ELSE 0.0 END) FROM j),
                 (SELECT count(*) FROM j)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM pc
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support)::BIGINT FROM pc""", EVAL_CTE + """,
pc AS (SELECT CASE c WHEN 0 THEN 'Normal' ELSE 'Anomaly' END AS class,
              CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS precision,
              CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS recall,
              CASE WHEN pp + sup = 0 THEN 0.0 ELSE 2 * tp / (pp + sup) END AS f1, sup::BIGINT AS support
       FROM (SELECT c.c, count(*) FILTER (WHERE j.gt_label = c.c AND j.prediction_bin = c.c)::DOUBLE AS tp,
                    count(*) FILTER (WHERE j.prediction_bin = c.c)::DOUBLE AS pp,
                    count(*) FILTER (WHERE j.gt_label = c.c) AS sup
             FROM (VALUES (0), (1)) c(c) CROSS JOIN j GROUP BY c.c))"""))
def class_report(spark, sf_dir):
    return EV.class_report(_joined(spark, sf_dir))


@register("roc_auc_ap", "A19,A20,W7", with_flow("""
SELECT sum(CASE WHEN p.gt_label = 1 AND n.gt_label = 0 THEN
             CASE WHEN p.anomaly_score < n.anomaly_score THEN 1.0 WHEN p.anomaly_score = n.anomaly_score THEN 0.5 ELSE 0.0 END
           END) / (count(DISTINCT CASE WHEN p.gt_label = 1 THEN p.event_id END)::DOUBLE
                   * count(DISTINCT CASE WHEN n.gt_label = 0 THEN n.event_id END)::DOUBLE) AS roc_auc,
       (SELECT sum(pos / (SELECT count(*) FILTER (WHERE gt_label = 1) FROM j)::DOUBLE * cp / (cp + cn))
        FROM (SELECT anomaly_score, pos,
                     sum(pos) OVER (ORDER BY anomaly_score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS cp,
                     sum(neg) OVER (ORDER BY anomaly_score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS cn
              FROM (SELECT anomaly_score, count(*) FILTER (WHERE gt_label = 1) AS pos,
                           count(*) FILTER (WHERE gt_label <> 1) AS neg FROM j GROUP BY anomaly_score))) AS average_precision
FROM (SELECT * FROM j WHERE gt_label = 1) p CROSS JOIN (SELECT * FROM j WHERE gt_label = 0) n""", EVAL_CTE))
def roc_auc_ap(spark, sf_dir):
    return EV.roc_auc_ap(_joined(spark, sf_dir))


@register("pr_curve", "A21", with_flow("""
SELECT anomaly_score AS threshold, cp AS tp, cn AS fp, cp::DOUBLE / (cp + cn) AS precision,
       cp::DOUBLE / (SELECT count(*) FILTER (WHERE gt_label = 1) FROM j) AS recall
FROM (SELECT anomaly_score,
             (SELECT count(*) FROM j j2 WHERE j2.gt_label = 1 AND j2.anomaly_score <= g.anomaly_score) AS cp,
             (SELECT count(*) FROM j j2 WHERE j2.gt_label <> 1 AND j2.anomaly_score <= g.anomaly_score) AS cn
      FROM (SELECT DISTINCT anomaly_score FROM j) g)""", EVAL_CTE))
def pr_curve(spark, sf_dir):
    return EV.pr_curve(_joined(spark, sf_dir))


@register("percentile_threshold", "M5,A22,F19", with_flow(f"""
SELECT event_id, anomaly_score, t.thr AS threshold,
       CASE WHEN anomaly_score < t.thr THEN -1 ELSE 1 END AS prediction,
       CASE WHEN anomaly_score < t.thr THEN 1 ELSE 0 END AS is_anomaly,
       CASE WHEN anomaly_score < t.thr THEN 'anomaly' ELSE 'normal' END AS label
FROM flow, (SELECT quantile_cont(anomaly_score, {PCT}) AS thr FROM flow) t"""))
def percentile_threshold(spark, sf_dir):
    f = flows(spark, sf_dir)
    thr = TH.quantile_threshold(f, "anomaly_score", PCT)
    return TH.label_by_threshold(f, thr).select("event_id", "anomaly_score", "threshold", "prediction",
                                               "is_anomaly", "label")


@register("f1_sweep", "M6,L6,U4", with_flow("SELECT * FROM sel", EVAL_CTE + "," + _sweep_sql(F1_GRID, None, PCT)))
def f1_sweep(spark, sf_dir):
    return TH.best_threshold(_joined(spark, sf_dir), grid=F1_GRID, min_precision=None)


@register("f1_sweep_min_precision", "M7,L6", with_flow(
    "SELECT * FROM sel", EVAL_CTE + "," + _sweep_sql(MP_GRID, K.MIN_PRECISION_FOR_THRESHOLD, PCT)))
def f1_sweep_min_precision(spark, sf_dir):
    return TH.best_threshold(_joined(spark, sf_dir), grid=MP_GRID, min_precision=K.MIN_PRECISION_FOR_THRESHOLD)


def _selected_threshold(spark, sf_dir):
    j = _joined(spark, sf_dir)
    thr = TH.best_threshold(j, grid=MP_GRID, min_precision=K.MIN_PRECISION_FOR_THRESHOLD).first()["threshold"]
    return j, thr


_FNFP_CTE = EVAL_CTE + "," + _sweep_sql(MP_GRID, K.MIN_PRECISION_FOR_THRESHOLD, PCT) + """,
fnr AS (SELECT * FROM j WHERE gt_label = 1 AND anomaly_score >= (SELECT threshold FROM sel)),
fpr AS (SELECT * FROM j WHERE gt_label = 0 AND anomaly_score < (SELECT threshold FROM sel))
"""


@register("fn_fp_samples", "M8,L3", with_flow("""
SELECT * FROM (SELECT 'fn' AS kind, event_id, anomaly_score, gt_label, proto, dest_port FROM fnr
               ORDER BY anomaly_score DESC, event_id ASC LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'fp' AS kind, event_id, anomaly_score, gt_label, proto, dest_port FROM fpr
               ORDER BY anomaly_score ASC, event_id ASC LIMIT 20)""", _FNFP_CTE))
def fn_fp_samples(spark, sf_dir):
    j, thr = _selected_threshold(spark, sf_dir)
    return EV.fn_fp_samples(j, thr).select("kind", "event_id", "anomaly_score", "gt_label", "proto", "dest_port")


def _profile_sql(src, kind):
    return f"""
SELECT '{kind}' AS kind, 'top_proto' AS stat, proto, n::DOUBLE AS value
FROM (SELECT proto, count(*) AS n FROM {src} GROUP BY proto ORDER BY n DESC, proto ASC LIMIT 3)
UNION ALL
SELECT '{kind}', s.stat, NULL, s.value FROM (
  SELECT unnest(['count', 'mean', 'std', 'min', 'p50', 'p90', 'p99', 'max']) AS stat,
         unnest([count(dest_port)::DOUBLE, avg(dest_port), stddev_samp(dest_port), min(dest_port)::DOUBLE,
                 quantile_cont(dest_port::DOUBLE, 0.5), quantile_cont(dest_port::DOUBLE, 0.9),
                 quantile_cont(dest_port::DOUBLE, 0.99), max(dest_port)::DOUBLE]) AS value FROM {src}) s"""


@register("fn_fp_profile", "A23,A24", with_flow(
    _profile_sql("fnr", "fn") + "\nUNION ALL\n" + _profile_sql("fpr", "fp"), _FNFP_CTE))
def fn_fp_profile(spark, sf_dir):
    j, thr = _selected_threshold(spark, sf_dir)
    fn, fp = EV.fn_fp(j, thr)
    out = None
    for kind, d in (("fn", fn), ("fp", fp)):
        protos, desc = EV.profile(d, kind)
        p = protos.select("kind", F.lit("top_proto").alias("stat"), "proto", F.col("n").cast("double").alias("value"))
        stats = ["count", "mean", "std", "min", "p50", "p90", "p99", "max"]
        dl = desc.select("kind", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"),
                                                              F.col(s).cast("double").alias("value")) for s in stats])).alias("s")) \
                 .select("kind", "s.stat", F.lit(None).cast("string").alias("proto"), "s.value")
        part = p.unionByName(dl)
        out = part if out is None else out.unionByName(part)
    return out


@register("label_counts", "A13", with_flow("""
SELECT 'training_label' AS kind, training_label AS value, count(*) AS n FROM scored GROUP BY training_label
UNION ALL SELECT 'prediction', CAST(prediction AS VARCHAR), count(*) FROM scored GROUP BY prediction"""))
def label_counts(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return EV.value_counts(s, "training_label").unionByName(EV.value_counts(s, "prediction"))


@register("minmax_scale", "F21", with_flow("""
SELECT event_id,
  (packet_length - lo_p) / nullif(hi_p - lo_p, 0) AS packet_length,
  (dest_port - lo_d) / nullif(hi_d - lo_d, 0) AS dest_port,
  (alert_severity - lo_s) / nullif(hi_s - lo_s, 0) AS alert_severity
FROM flow, (SELECT min(packet_length)::DOUBLE lo_p, max(packet_length)::DOUBLE hi_p, min(dest_port)::DOUBLE lo_d,
                   max(dest_port)::DOUBLE hi_d, min(alert_severity)::DOUBLE lo_s, max(alert_severity)::DOUBLE hi_s
            FROM flow WHERE training_session = 'session-a') t"""))
def minmax_scale(spark, sf_dir):
    f = flows(spark, sf_dir)
    cols = ["packet_length", "dest_port", "alert_severity"]
    params = SC.minmax_fit(f.where(F.col("training_session") == SESSION), cols)
    return SC.minmax_transform(f, params).select("event_id", *cols)


_RS = ["packet_length", "dest_port", "src_port", "alert_severity", "anomaly_score"]


@register("robust_scale", "M1", with_flow("SELECT event_id, " + ", ".join(
    f"(flow.{c} - q.q_{c}[2]) / CASE WHEN q.q_{c}[3] - q.q_{c}[1] = 0 THEN 1 ELSE q.q_{c}[3] - q.q_{c}[1] END AS {c}"
    for c in _RS)
    + " FROM flow, (SELECT " + ", ".join(f"quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q_{c}" for c in _RS)
    + " FROM flow) q"))
def robust_scale(spark, sf_dir):
    f = flows(spark, sf_dir)
    return SC.robust_scale(f, _RS).select("event_id", *[F.col(c).cast("double").alias(c) for c in _RS])
