"""Model queries.  A random forest has no SQL twin, so the fitted ones are
rows-only; scoring is checked against a recursive SQL walk of a fixed node
table, fitting by facts that do not depend on chance, and both by property
tests in tests/test_iforest.py."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.operators import evaluate as EV
from netsleuth.operators import iforest as IF
from netsleuth.plans import detect as D
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.registry import register
from netsleuth.schemas import ISOLATION_NODE
from netsleuth.session import materialize
from netsleuth.sources.flowview import flows

SESSION = "session-a"

# A small fixed forest: (tree, node, feature, threshold, left, right, size, depth).
FOREST_FEATURES = ["packet_length", "dest_port", "alert_severity"]
FOREST_PSI, FOREST_OFFSET = 16, -0.55
FOREST_NODES = [
    (0, 0, 0, 150.0, 1, 2, 16, 0), (0, 1, 1, 50.0, 3, 4, 13, 1), (0, 2, -1, 0.0, -1, -1, 3, 1), (0, 3, -1, 0.0, -1, -1, 7, 2),
    (0, 4, -1, 0.0, -1, -1, 6, 2),
    (1, 0, 2, 0.5, 1, 2, 16, 0), (1, 1, 0, 20.0, 3, 4, 14, 1), (1, 2, -1, 0.0, -1, -1, 2, 1), (1, 3, -1, 0.0, -1, -1, 1, 2),
    (1, 4, -1, 0.0, -1, -1, 13, 2),
    (2, 0, 1, 90.0, 1, 2, 16, 0), (2, 1, 0, 400.0, 3, 4, 15, 1), (2, 2, -1, 0.0, -1, -1, 1, 1), (2, 3, -1, 0.0, -1, -1, 14, 2),
    (2, 4, -1, 0.0, -1, -1, 1, 2),
]


def fixed_forest() -> IF.IsolationForestModel:
    nodes = pd.DataFrame(FOREST_NODES, columns=[f.name for f in ISOLATION_NODE.fields])
    return IF.IsolationForestModel(FOREST_FEATURES, 3, FOREST_PSI, 0.05, 42, nodes, FOREST_OFFSET)


_LENGTH = "CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"
_WALK = (
    "nodes(tree_id, node_id, feature, threshold, l, r, size, depth) AS (VALUES "
    + ", ".join(f"({t}, {n}, {f}, {th}::DOUBLE, {a}, {b}, {s}, {d})" for t, n, f, th, a, b, s, d in FOREST_NODES) + """),
walk(event_id, p, d, s, tree_id, node_id) AS (
  SELECT event_id, packet_length, dest_port, alert_severity, t.tree_id, 0 FROM flow, (SELECT DISTINCT tree_id FROM nodes) t
  UNION ALL
  SELECT w.event_id, w.p, w.d, w.s, w.tree_id,
         CASE WHEN coalesce(CASE n.feature WHEN 0 THEN w.p WHEN 1 THEN w.d ELSE w.s END, 0) <= n.threshold THEN n.l ELSE n.r END
  FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.feature >= 0),
leaf AS (SELECT w.event_id, avg(n.depth + """ + _LENGTH.format(n="n.size") + """) AS h
         FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id AND n.feature < 0 GROUP BY w.event_id),
fs AS (SELECT event_id, -power(2.0, -h / (""" + _LENGTH.format(n=f"{FOREST_PSI}") + f""")) - ({FOREST_OFFSET}) AS anomaly_score FROM leaf)
""")


@register("forest_fixed_score", "M3,M4,M9", with_flow("""
SELECT event_id, round(anomaly_score, 9) AS anomaly_score, CASE WHEN anomaly_score < 0 THEN -1 ELSE 1 END AS prediction
FROM fs""", _WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def forest_fixed_score(spark, sf_dir):
    """Every event scored by a small fixed node table."""
    s = fixed_forest().score(flows(spark, sf_dir).drop("anomaly_score"))
    return s.select("event_id", F.round("anomaly_score", 9).alias("anomaly_score"), "prediction")


@register("iforest_facts", "M2", with_flow("""
SELECT 100 AS trees, least(256, count(*)) AS rows_per_tree, 100 AS full_trees, true AS depth_kept, true AS share_kept
FROM flow WHERE training_label = 'normal'"""))
def iforest_facts(spark, sf_dir):
    """Facts of a fitted forest that do not depend on chance: trees, rows at
    each root, the height limit, and the flagged share of the training rows."""
    stored = flows(spark, sf_dir).drop("anomaly_score")
    rows = stored.where("training_label = 'normal'")
    model = IF.fit(rows, FOREST_FEATURES)
    roots = spark.createDataFrame(model.nodes, ISOLATION_NODE)      # bounded by trees and samples
    # rows below the interpolated quantile: at most the one beside it more than the share
    flagged = model.score(rows).agg((F.count_if(F.col("anomaly_score") < 0)
                                     <= F.floor(K.IFOREST_CONTAMINATION * (F.count(F.lit(1)) - 1)) + 1).alias("x")).scalar()
    return roots.agg(
        F.count_distinct("tree_id").cast("int").alias("trees"),
        F.max(F.when(F.col("depth") == 0, F.col("size"))).cast("long").alias("rows_per_tree"),
        F.count_if((F.col("depth") == 0) & (F.col("size") == model.psi)).cast("int").alias("full_trees"),
        (F.max("depth") <= F.ceil(F.log2(F.lit(float(model.psi))))).alias("depth_kept"),
        F.first(flagged).alias("share_kept"))


@register("iforest_fit_score", "M2,M3,M4,M9,M1")
def iforest_fit_score(spark, sf_dir):
    """Robust-scale the feature table, fit the forest on normal rows, score all."""
    stored = flows(spark, sf_dir).drop("anomaly_score")
    det, ft = D.train(stored)
    return det.score(ft).select("event_id", "anomaly_score", "prediction", "training_label")


@register("score_and_rules", "M10,M5,M7")
def score_and_rules(spark, sf_dir):
    """Train, score every stored event, pick the threshold on the labelled
    session (M7), then generate the rules (M10)."""
    stored = flows(spark, sf_dir).drop("anomaly_score")
    det, ft = D.train(stored)
    scored = materialize(D.score_events(stored, det, ft))     # read by the sweep and the rule run
    gt = EV.ground_truth(stored, SESSION).select("event_id", "prediction_g")
    thr = D.select_threshold(scored, gt)
    run = D.score_and_rules(stored, det, thr, scored=scored)
    return run["new_rules"].select("kind", "sid", "text")
