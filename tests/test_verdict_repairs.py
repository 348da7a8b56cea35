"""Quantiles, toggles, rule admissibility, evaluation counts, detector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsleuth.operators import evaluate as EV
from netsleuth.operators import explore as EX
from netsleuth.operators import rules as R
from netsleuth.operators import scaling as SC
from netsleuth.operators import thresholds as TH


def test_quantiles_are_exact_over_many_chunks(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])           # a third of the rows share a value
    rows = [(float(x), float(i % 7), None) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.03, 0.25, 0.5, 0.75, 0.9, 1.0]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            q = SC.quantiles(df, ["a", "b", "c"], probs)
            assert q["a"] == pytest.approx(np.quantile(a, probs).tolist(), abs=1e-12)
            assert q["b"] == pytest.approx(np.quantile([i % 7 for i in range(len(a))], probs).tolist())
            assert q["c"] == [None] * len(probs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    small = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert SC.quantiles(small, ["x"], [0.25, 0.5, 0.75])["x"] == [1.75, 2.5, 4.75]
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 0)], "x double, n int")
    assert SC.quantiles(weighted, ["x"], [0.5, 1.0], "n")["x"] == [1.0, 2.0]


def test_labels_follow_one_rule(spark):
    """A NULL label is no class: not in the sweep, the matrix or the curve."""
    df = spark.createDataFrame([(0.1, 1, 1), (0.2, 0, 1), (0.3, None, 1), (0.9, 0, 0)], "anomaly_score double, gt_label int, prediction_bin int")
    t = {r.threshold: (r.tp, r.fp, r.fn) for r in TH.sweep_table(df, [0.15, 0.5], "gt_label", "anomaly_score").collect()}
    assert t == {0.15: (1, 0, 0), 0.5: (1, 1, 0)}
    same = TH.sweep_table(EV.score_counts(df), [0.15, 0.5], "gt_label", "anomaly_score").collect()
    assert {r.threshold: (r.tp, r.fp, r.fn) for r in same} == t
    assert {(r.gt_label, r.prediction): r.n for r in EV.confusion(df).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1}
    assert EV.roc_auc_ap(df).first().roc_auc == 1.0


def test_weighted_average_without_both_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "gt_label int, prediction_bin int")
    r = EV.prf(df).first()
    assert r.average == "weighted" and r.precision == 1.0 and r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(0.8)
    plan = EV.class_report(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1                                       # the rows are read once


def test_last_toggle_counts(spark):
    lines = spark.createDataFrame([("alert ip 1.1.1.1 any -> any any (sid:7; rev:1;)",), ("#alert ip 2.2.2.2 any -> any any (sid:8; rev:1;)",)], "text string")
    timed = spark.createDataFrame([(7, "disable", 1), (7, "enable", 2), (8, "enable", 1), (8, "disable", 0)], "sid int, status string, at int")
    assert sorted(r.text[0] for r in R.toggle(lines, timed).collect()) == ["a", "a"]
    untimed = spark.createDataFrame([(7, "disable"), (7, "enable")], "sid int, status string")
    assert sorted(r.text[0] for r in R.toggle(lines, untimed).collect()) == ["#", "#"]


def _anomalies(spark, rows):
    return spark.createDataFrame([(str(i), "TCP", s, "9.9.9.9", p, 80, -0.5, -1, 1, 10, dest) for i, (s, p, dest) in enumerate(rows)],
                                 "event_id string, proto string, src_ip string, x string, src_port string, dest_port int, anomaly_score double, "
                                 "prediction int, alert_severity int, packet_length int, dest_ip string")


def test_unreadable_port_gives_no_rule_and_services_are_a_parameter(spark):
    df = _anomalies(spark, [("1.1.1.1", "abc", "8.8.8.8"), ("1.1.1.2", "500", "8.8.8.8"), ("1.1.1.3", None, "8.8.8.8"), ("1.1.1.4", "0", "7.7.7.7")])
    texts = [r.text for r in R.flow_rules(R.policy(df, 0.0).drop("x"), 0.0).collect()]
    assert len(texts) == 3 and not any("1.1.1.1" in t for t in texts) and any("1.1.1.2 500" in t for t in texts) and any("1.1.1.3 any" in t for t in texts)
    assert {r.src_ip for r in R.policy(df, 0.0, local_services=["8.8.8.8"]).collect()} == {"1.1.1.4"}


def test_day_filter_prunes_partitions(spark, tmp):
    ev = spark.createDataFrame([(1, "2024-01-10T23:30:00-0200", "2024-01-11 01:30:00"), (2, "2024-01-10T12:00:00+0000", "2024-01-10 12:00:00"),
                                (3, "2024-01-12T00:00:00+0000", "2024-01-12 00:00:00")], "flow_id long, timestamp_raw string, t string")
    ev = ev.withColumn("timestamp", F.to_timestamp("t")).withColumn("event_date", F.to_date("timestamp"))
    path = tmp + "/day"
    ev.write.partitionBy("event_date").parquet(path)
    got = EX.logs_by_day(spark.read.parquet(path), "2024-01-10")
    assert [r.flow_id for r in got.collect()] == [1, 2]
    assert "PartitionFilters: [isnotnull(event_date" in got._jdf.queryExecution().executedPlan().toString()


def test_detector_round_trip_and_rule_run(spark, tmp):
    from netsleuth.operators.explore import mark_processed
    from netsleuth.plans import detect as D
    from netsleuth.sources.flowview import flows
    stored = flows(spark, "/root/testdata/sf0.001").drop("anomaly_score")
    det, ft = D.train(stored, n_trees=10, max_samples=64)
    det.save(spark, tmp + "/det")
    back = D.Detector.load(spark, tmp + "/det")
    a = {r.event_id: r.anomaly_score for r in det.score(ft).collect()}
    one = ft.limit(1)
    assert back.score(one).first().anomaly_score == pytest.approx(a[one.first().event_id])
    assert back.codes == det.codes and back.scaler == det.scaler
    holes = one.withColumn("packet_length", F.lit(float("nan"))).drop("hour")
    assert np.isfinite(back.score(holes).first().anomaly_score)
    ledger = mark_processed(stored.where("flow_id < 900"), at="2024-01-01 00:00:00")
    off = spark.createDataFrame([("2024-01-01 00:00:00", "off"), ("2023-01-01 00:00:00", "normal")], "t string, mode string").select(
        F.to_timestamp("t").alias("effective_from"), "mode")
    run = D.rule_run(stored, ledger, back, 0.0, off)
    assert run["scored"].count() == run["ledger_rows"].count() == stored.count() - ledger.count()
    training = off.withColumn("mode", F.when(F.col("mode") == "off", "anomaly").otherwise("off"))
    paused = D.rule_run(stored, ledger, back, 0.0, training)
    assert list(paused) == ["ledger_rows"] and paused["ledger_rows"].count() == stored.count() - ledger.count()
