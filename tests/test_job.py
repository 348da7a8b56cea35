"""Serving against history, the scheduled job and its sinks."""

import math
import os

import pytest
from pyspark.sql import functions as F

from netsleuth.operators import features as FT
from netsleuth.operators import ingest as IG
from netsleuth.operators import rules as R
from netsleuth.operators import state as ST
from netsleuth.operators.ledger import Ledger
from netsleuth.plans import detect as D
from netsleuth.plans import job as J
from netsleuth.plans.q_detect import fixed_forest
from netsleuth.sources import artifacts as A
from netsleuth.sources import versions
from netsleuth.sources.flowview import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    """Stored events with ties, two without a time and two without a source."""
    f = IG.with_event_date(flows(spark, SF).drop("anomaly_score"))
    odd = f.limit(4).withColumn("event_id", F.concat(F.lit("odd"), F.monotonically_increasing_id()))
    odd = odd.withColumn("timestamp", F.when(F.col("event_id") < "odd2", None).otherwise(F.col("timestamp"))) \
        .withColumn("src_ip", F.when(F.col("event_id") < "odd2", F.col("src_ip")))
    return f.unionByName(IG.with_event_date(odd)).cache()


def same_rows(got, want):
    a, b = ({r.event_id: r.asDict() for r in d.collect()} for d in (got, want))
    assert a.keys() <= b.keys() and a
    for k, row in a.items():
        for c, v in row.items():
            w = b[k][c]
            assert v == w or math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9), (k, c, v, w)
    return a


@pytest.mark.parametrize("late", [False, True])
def test_last_batch_has_the_features_of_the_whole_store(spark, events, tmp, late):
    """However the events before were batched, and also if the last batch has
    events from before and between theirs."""
    part = F.col("flow_id") % 3 if late else F.when(F.coalesce(F.col("timestamp") < "2024-01-10", F.lit(True)), 0) \
        .when(F.col("timestamp") < "2024-01-20", 1).otherwise(2)
    d = events.withColumn("_b", F.coalesce(part, F.lit(0)))
    state = ST.FeatureState(spark, tmp + "/state")
    for b in range(3):
        state.add(d.where(F.col("_b") == b).drop("_b"), b)
    last = d.where("_b = 2").drop("_b")
    want = FT.features(events)
    got = same_rows(ST.serving_features(last, events, state), want)
    state.add(last, 2)                                   # a batch counts once
    state.compact()
    same_rows(ST.serving_features(last, events, state), want)
    flags = same_rows(ST.serving_features(last, events, state, failed_by_flags=True), FT.features(events, failed_by_flags=True))
    assert flags.keys() == got.keys()
    h = {r.src_ip: (r.n_hist, r.port_min, r.port_max) for r in ST.history_stats(state, events, min_events=0).collect()}
    known = R.history_stats(events, min_events=0).where("src_ip is not null")
    assert h == {r.src_ip: (r.n_hist, r.port_min, r.port_max) for r in known.collect()}


def test_small_batches_score_as_one(spark, events, tmp):
    one = events.where("flow_id = 7")
    state = ST.FeatureState(spark, tmp + "/state")
    state.add(events.where("flow_id <> 7"), 0)
    state.add(one, 1)
    same_rows(ST.serving_features(one, events, state), FT.features(events))
    state.add(events.limit(0), 2)
    assert ST.serving_features(events.limit(0), events, state).count() == 0


def _paths(tmp):
    return J.JobPaths(*[f"{tmp}/{n}" for n in ("store", "state", "scores", "rules", "ledger", "thresholds", "modes")])


class Killed(Exception):
    pass


def test_killed_job_leaves_each_event_once(spark, events, tmp, monkeypatch):
    monkeypatch.setattr(J, "COMPACT_AFTER", 2)
    paths, det = _paths(tmp), D.Detector({}, fixed_forest(), {})
    events.write.partitionBy("event_date").parquet(paths.store)
    A.write_thresholds(spark.range(1).select(F.lit(0.05).alias("threshold")), paths.thresholds)
    half = events.count() // 2

    def run(batch, sink=None):
        def step(done):
            if done == sink:
                raise Killed
        return J.run_batch(spark, paths, det, batch, size=half, step=step)
    seen = []
    for sink in ("state", "scores", "rules", "ledger", None):
        if sink is None:
            assert run(0)["threshold"] == 0.05
        else:
            with pytest.raises(Killed):
                run(0, sink)
            seen.append(versions.current(spark, paths.rules))
    assert seen == [None, None, 0, 0]
    assert J.scores(spark, paths).count() == half
    first = [r.value for r in A.read_rules(spark, paths.rules).collect()]
    with pytest.raises(Killed):
        run(1, "scores")
    assert [r.value for r in A.read_rules(spark, paths.rules).collect()] == first       # the old file is whole
    run(1)
    run(2)
    assert versions.published(spark, paths.state + "/compact") == [1]
    ledger = Ledger(spark, paths.ledger, paths.store)
    assert ledger.pending().count() == 0 and ledger.open_days() == []
    for sink in (J.scores(spark, paths), ledger.rows()):
        assert sink.count() == sink.select("event_id").distinct().count() == events.count()
    rules = [r.value for r in A.read_rules(spark, paths.rules).orderBy("line_no").collect()]
    assert rules[:len(first)] == first and len(rules) > len(first) and len(set(rules)) == len(rules)


def test_training_mode_records_progress_only(spark, events, tmp):
    paths, det = _paths(tmp), D.Detector({}, fixed_forest(), {})
    events.write.partitionBy("event_date").parquet(paths.store)
    A.append_mode(spark, paths.modes, "anomaly", at="2024-01-01 00:00:00")
    out = J.run_batch(spark, paths, det, 0, size=300)
    assert out["training"] and versions.current(spark, paths.scores) is None and A.rule_file(spark, paths.rules) is None
    ledger = Ledger(spark, paths.ledger, paths.store)
    assert ledger.rows().count() == 300 and ledger.pending().count() == events.count() - 300
    A.append_mode(spark, paths.modes, "off", at="2024-02-01 00:00:00")
    assert J.run_batch(spark, paths, det, 0)["training"]                # decided when the batch was claimed
    assert not J.run_batch(spark, paths, det, 1)["training"]
    assert J.scores(spark, paths).count() == events.count() - 300 and ledger.pending().count() == 0


def test_job_on_a_stream_of_stored_events(spark, events, tmp):
    paths, det = _paths(tmp), D.Detector({}, fixed_forest(), {})
    cut = F.coalesce(F.col("flow_id") < 600, F.lit(True))
    for part in (events.where(cut), events.where(~cut)):
        part.write.mode("append").partitionBy("event_date").parquet(paths.store)
        schema = spark.read.parquet(paths.store).schema
        J.start_job(spark, paths, det, schema, tmp + "/ckpt", trigger={"availableNow": True}).awaitTermination()
    assert versions.published(spark, paths.scores) == [0, 1]
    assert J.scores(spark, paths).groupBy("event_id").count().where("count = 1").count() == events.count()


def test_closed_days_are_not_read_and_late_events_open_them(spark, events, tmp):
    store = f"{tmp}/store"
    days = [str(r[0]) for r in events.select("event_date").distinct().where("event_date is not null").orderBy("event_date").collect()]
    late = (F.col("event_date") == days[0]) & (F.col("flow_id") % 5 == 0)
    events.where(~late).write.partitionBy("event_date").parquet(store)
    ledger = Ledger(spark, f"{tmp}/ledger", store)
    ledger.mark(ledger.stored().where(F.col("event_date") <= days[1]), 0)
    ledger.mark(ledger.stored().where(F.col("event_date") <= days[1]), 0)              # once
    assert sorted(ledger.close(0)) == days[:2]
    assert ledger.rows().count() == events.where(~late & (F.col("event_date") <= days[1])).count()
    plan = ledger.pending()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [event_date") + plan.count("PartitionFilters: [(event_date") >= 2 and days[0] not in ledger.open_days()
    before = ledger.pending().count()
    events.where(late).write.mode("append").partitionBy("event_date").parquet(store)
    assert days[0] in ledger.open_days() and ledger.pending().count() == before + events.where(late).count()
    part = ledger.pending(10)
    assert part.count() == 10


def test_publishing_is_all_or_nothing(spark, tmp):
    path = tmp + "/v"
    lines = lambda *t: spark.createDataFrame([(0, i, "flow", x, True) for i, x in enumerate(t)], "section int, line_no int, kind string, text string, enabled boolean")
    A.publish_rules(spark, lines("a", "b"), path, 3)

    def broken(target):
        os.makedirs(target)
        raise Killed
    with pytest.raises(Killed):
        versions.publish(spark, path, 4, broken)
    assert [r.value for r in A.read_rules(spark, path).collect()] == ["a", "b"]
    A.publish_rules(spark, lines("c"), path, 4)
    A.publish_rules(spark, lines("never"), path, 4)
    assert [r.value for r in A.read_rules(spark, path).collect()] == ["c"]
    assert [r.value for r in A.read_rules(spark, path, below=4).collect()] == ["a", "b"]
    assert versions.published(spark, path) == [3, 4] and A.read_rules(spark, tmp + "/none").count() == 0
