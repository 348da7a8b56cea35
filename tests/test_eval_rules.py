import numpy as np
import pytest
from pyspark.sql import functions as F

from netsleuth.operators import evaluate as EV
from netsleuth.operators import rules as R
from netsleuth.operators import scaling as SC
from netsleuth.operators import thresholds as TH


def test_robust_scale_fixture(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, y double")
    out = SC.robust_scale(df, ["x", "y"]).collect()
    assert [r.x for r in out] == pytest.approx([-0.5, -1 / 6, 1 / 6, 2.5])
    assert [r.y for r in out] == [0.0] * 4


def test_auc_ap_with_ties(spark):
    # anomaly scores .9 .5 .5 .1 -> normality score is the negation
    df = spark.createDataFrame([(-0.9, 1), (-0.5, 1), (-0.5, 0), (-0.1, 0)], "anomaly_score double, gt_label int")
    r = EV.roc_auc_ap(df).first()
    assert r.roc_auc == pytest.approx(0.875)
    assert r.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 500)
    s = rng.normal(size=500) - y
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "anomaly_score double, gt_label int")
    grid = (0.05, 0.6, 25)
    ths = sorted(set(np.quantile(s, np.linspace(*grid))))
    table = {round(r.threshold, 12): r for r in TH.sweep_table(df, ths, "gt_label", "anomaly_score").collect()}
    best = None
    for t in ths:
        pred = s < t
        tp, fp, fn = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()), int((~pred & (y == 1)).sum())
        r = table[round(float(t), 12)]
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn)
        if best is None or f1 > best[1]:
            best = (t, f1)
    got = TH.best_threshold(df, grid=grid, min_precision=None).first()
    assert got.threshold == pytest.approx(best[0]) and got.f1 == pytest.approx(best[1])
    none = TH.best_threshold(df, grid=grid, min_precision=1.01).first()
    assert none.f1 == 0.0 and none.threshold == pytest.approx(float(np.quantile(s, 0.02)))


def test_prf_binary_and_weighted(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "gt_label int, prediction_bin int")
    r = EV.prf(df).first()
    assert r.average == "binary" and r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3)
    one = spark.createDataFrame([(0, 1), (0, 0)], "gt_label int, prediction_bin int")
    w = EV.prf(one).first()
    assert w.average == "weighted" and w.precision == pytest.approx(1.0) and w.recall == pytest.approx(0.5)
    cm = {(r.gt_label, r.prediction): r.n for r in EV.confusion(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_ground_truth_text_labels_and_join(spark):
    gt = spark.createDataFrame([("1", "anomaly"), ("2", "normal")], "event_id string, label string")
    scores = spark.createDataFrame([("1", -0.3, -1), ("2", 0.2, 1)], "event_id string, anomaly_score double, prediction int")
    j = EV.join_scores(scores, gt).orderBy("event_id").collect()
    assert [(r.gt_label, r.prediction_bin) for r in j] == [(1, 1), (0, 0)]


def _scored(spark, rows):
    return spark.createDataFrame(rows, "event_id string, proto string, src_ip string, dest_ip string, src_port int, "
                                       "dest_port int, alert_severity int, packet_length int, anomaly_score double, prediction int")


def test_rule_dedup_icmp_first_blocks(spark):
    rows = [("1", "ICMP", "10.0.0.5", "192.168.10.20", 0, 22, 0, 60, -0.5, -1),
            ("2", "TCP", "10.0.0.5", "192.168.10.20", 5, 22, 0, 60, -0.3, -1)]
    run = R.generate(_scored(spark, rows), _scored(spark, rows), 0.2, checkpoint=False)
    assert run["dedup"].count() == 2
    assert run["candidates"].count() == 1
    assert run["flow_rules"].count() == 0


def test_flow_rule_text_and_drop_policy(spark):
    rows = [(str(i), "TCP", "10.0.0.5", "192.168.10.20", 0, 8080, 2, 60, -0.30 - i / 1000, -1) for i in range(5)]
    rows.append(("9", "UDP", "10.0.0.6", "10.0.2.3", 1, 53, 3, 10, -0.5, -1))       # local service: excluded
    run = R.generate(_scored(spark, rows), _scored(spark, rows), 0.2, checkpoint=False)
    fr = run["flow_rules"].collect()
    assert len(fr) == 1
    text = fr[0].text
    assert text.startswith("drop tcp 10.0.0.5 any -> 192.168.10.20 8080 (msg:\"ML anomaly (score: -0.30, len: 60, severity: 2, thr: 0.20)\"; sid:")
    import hashlib
    uid = "10.0.0.5-192.168.10.20-tcp-8080-2-60-" + str(round(-0.304, 3))
    assert fr[0].sid == 3_000_000 + int(hashlib.sha256(uid.encode()).hexdigest(), 16) % 500_000


def test_toggle_and_inventory(spark):
    lines = spark.createDataFrame([
        (0, "alert tcp 1.1.1.1 any -> 2.2.2.2 22 (msg:\"a\"; sid:11; rev:1;)"),
        (1, "##alert ip 3.3.3.3 any -> any any (msg:\"b\"; sid:12; rev:1;)"),
        (2, "#drop tcp 1.1.1.1 any -> 2.2.2.2 80 (msg:\"c\"; sid:13; rev:1;)")], "line_no int, text string")
    toggles = spark.createDataFrame([(11, "disable"), (12, "enable"), (13, "disable")], "sid long, status string")
    out = [r.text for r in R.toggle(lines, toggles).orderBy("line_no").collect()]
    assert out[0].startswith("#alert") and out[1].startswith("alert ip") and out[2].startswith("#drop")
    inv = R.inventory(lines.withColumn("file", F.lit("x.rules")).withColumnRenamed("text", "value")).first()
    assert (inv.rules, inv.enabled, inv.disabled, inv.managed, inv.manual) == (3, 1, 2, 1, 2)


def test_new_rules_anti_join(spark):
    existing = R.parse_rule_lines(spark.createDataFrame(
        [(0, "alert ip 10.0.0.5 any -> any any (msg:\"old\"; sid:1; rev:1;)"),
         (1, "#alert tcp 10.0.0.5 any -> 1.1.1.1 22 (msg:\"x\"; sid:2; rev:1;)")], "line_no int, value string"))
    scans = spark.createDataFrame([("alert ip 10.0.0.5 any -> any any (msg:\"new\"; sid:3; rev:1;)", 3),
                                   ("alert ip 10.0.0.6 any -> any any (msg:\"new\"; sid:4; rev:1;)", 4)], "text string, sid long")
    flows = spark.createDataFrame([("alert tcp 10.0.0.5 any -> 1.1.1.1 22 (msg:\"y\"; sid:5; rev:1;)", 5)], "text string, sid long")
    ctx = spark.createDataFrame([("#nothing", 6)], "text string, sid long").limit(0)
    new = R.new_rules(existing, scans, ctx, flows).collect()
    assert [r.sid for r in new] == [4]
