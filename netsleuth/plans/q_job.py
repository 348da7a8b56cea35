"""Serving against history and the scheduled job (M9, M10, T4, S4, S11, K6,
K7, A10, J6, J10) in two batches over the flow view: events before the middle
of the time range, then the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth.operators import ingest as IG
from netsleuth.operators import state as ST
from netsleuth.operators.ledger import Ledger
from netsleuth.plans import detect as D
from netsleuth.plans import job as J
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.q_detect import _WALK, fixed_forest
from netsleuth.plans.q_rules import rules_sql
from netsleuth.plans.q_tables import _CUT, _mid, FEATURE_COLS, FEATURES_CTE
from netsleuth.plans.registry import register
from netsleuth.session import materialize, scratch_path, spread, written
from netsleuth.sources import artifacts as A
from netsleuth.sources.flowview import flows

#: Threshold that the job reads from the stored parameters.
JOB_THR = 0.05
_FIRST = 'coalesce("timestamp" < (SELECT mid FROM cut), true)'


def _stored(spark, sf_dir):
    """Events as the store has them, and the number of the batch of each."""
    f = IG.with_event_date(flows(spark, sf_dir).drop("anomaly_score"))
    return f.withColumn("_batch", F.when(F.coalesce(F.col("timestamp") < _mid(spark, sf_dir), F.lit(True)), 0).otherwise(1))


def _features_upto(batch: int) -> str:
    cond = f"WHERE {_FIRST}" if batch == 0 else ""
    ctes = FEATURES_CTE.replace("AS hour FROM flow)", f"AS hour FROM flow {cond})")
    keep = _FIRST if batch == 0 else f"NOT {_FIRST}"
    return f"SELECT {batch} AS batch, * FROM (WITH {ctes.strip()} SELECT * FROM ft WHERE event_id IN (SELECT event_id FROM flow WHERE {keep}))"


@register("served_features", "M9,M10,A1,A2,A3,A4,A5,A6,A7,W2,W3", with_flow(f"{_features_upto(0)} UNION ALL {_features_upto(1)}", _CUT))
def served_features(spark, sf_dir):
    """Feature rows of two batches as they are served: each batch against the
    state of all events so far.  The second batch's rows are those of one batch
    over the whole store."""
    d = written(spread(_stored(spark, sf_dir)), "stored-events")
    state = ST.FeatureState(spark, scratch_path(spark, "state"))
    out = []
    for batch in (0, 1):
        fresh = d.where(F.col("_batch") == batch).drop("_batch")
        state.add(fresh, batch)
        rows = ST.serving_features(fresh, d.where(F.col("_batch") <= batch).drop("_batch"), state)
        out.append(rows.select(F.lit(batch).alias("batch"), *FEATURE_COLS))
    return out[0].unionByName(out[1])


@register("history_summary", "A10,J6", with_flow("""
SELECT 0 AS batch, src_ip, count(*) AS n_hist, min(dest_port) AS port_min, max(dest_port) AS port_max FROM flow
WHERE """ + _FIRST + """ GROUP BY src_ip HAVING count(*) > 10
UNION ALL SELECT 1, src_ip, count(*), min(dest_port), max(dest_port) FROM flow GROUP BY src_ip HAVING count(*) > 10""", _CUT))
def history_summary(spark, sf_dir):
    """Rows and port range per source after each batch, from merged shares."""
    d = materialize(_stored(spark, sf_dir))
    state = ST.FeatureState(spark, scratch_path(spark, "state"))
    for batch in (0, 1):
        state.add(d.where(F.col("_batch") == batch).drop("_batch"), batch)
    return ST.history_stats(state, d, upto=0).select(F.lit(0).alias("batch"), "*") \
        .unionByName(ST.history_stats(state, d).select(F.lit(1).alias("batch"), "*"))


class _Killed(Exception):
    pass


def _run_job(spark, sf_dir) -> J.JobPaths:
    """Two batches of the job; the second is killed once after its scores and
    once after its rules, and started again."""
    d = materialize(_stored(spark, sf_dir))
    base = scratch_path(spark, "job")
    paths = J.JobPaths(*[f"{base}/{n}" for n in ("store", "state", "scores", "rules", "ledger", "thresholds")])
    d.drop("_batch").write.partitionBy("event_date").parquet(paths.store)
    A.write_thresholds(spark.range(1).select(F.lit(JOB_THR).alias("threshold")), paths.thresholds)
    detector = D.Detector({}, fixed_forest(), {})

    def killed_after(name):
        def step(done):
            if done == name:
                raise _Killed(name)
        return step
    for batch, sink in ((0, None), (1, "scores"), (1, "rules"), (1, None)):
        try:
            J.run_batch(spark, paths, detector, batch, fresh=d.where(F.col("_batch") == batch), at="2024-01-01 00:00:00", step=killed_after(sink))
        except _Killed:
            pass
    return paths


@register("scheduled_job_sinks", "M10,M9,T4,K7,K4", with_flow(f"""
SELECT CASE WHEN {_FIRST} THEN 0 ELSE 1 END AS batch, event_id, round(fs.anomaly_score, 9) AS anomaly_score,
       CASE WHEN fs.anomaly_score < 0 THEN -1 ELSE 1 END AS prediction, 1 AS n_scores, 1 AS n_ledger
FROM flow JOIN fs USING (event_id)""", _CUT + "," + _WALK).replace("WITH ", "WITH RECURSIVE ", 1))
def scheduled_job_sinks(spark, sf_dir):
    """Scores of every event and how often it is in the score and the ledger
    sink, after a run that was killed between sinks."""
    paths = _run_job(spark, sf_dir)
    once = J.scores(spark, paths).groupBy("event_id").agg(
        F.max("batch").alias("batch"), F.max("anomaly_score").alias("s"), F.max("prediction").alias("prediction"), F.count(F.lit(1)).cast("int").alias("n_scores"))
    ledger = Ledger(spark, paths.ledger, paths.store).rows().groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n_ledger"))
    return once.join(ledger, "event_id", "full").select("batch", "event_id", F.round("s", 9).alias("anomaly_score"), "prediction", "n_scores", "n_ledger")


_BATCH = """
sc{b} AS (SELECT flow.* EXCLUDE (anomaly_score), fs.anomaly_score, CASE WHEN fs.anomaly_score < 0 THEN -1 ELSE 1 END AS prediction
          FROM flow JOIN fs USING (event_id) WHERE {cond}),
"""
_NEW = """
{p}all AS (SELECT DISTINCT * FROM (SELECT 0 AS k, 'scan' AS kind, sid, text FROM {p}sr UNION ALL SELECT 1, 'context', sid, text FROM {p}cr
           UNION ALL SELECT 2, 'flow', sid, text FROM {p}fr))"""
_HEAD = "trim(split_part(text, '(', 1))"


@register("scheduled_job_rules", "M10,S11,K5,K6,S9,J7,U1,U2,U3,A10,J6", with_flow(f"""
SELECT CAST(row_number() OVER (ORDER BY b, k, text) - 1 AS INTEGER) AS line_no, text FROM (
  SELECT 0 AS b, k, text FROM a_all
  UNION ALL SELECT 1, k, text FROM b_all WHERE text NOT IN (SELECT text FROM a_all)
    AND (kind = 'context' OR {_HEAD} NOT IN (SELECT {_HEAD} FROM a_all)))""", _CUT + "," + _WALK.rstrip() + "," + _BATCH.format(b=0, cond=_FIRST)
    + f'f0 AS (SELECT * FROM flow WHERE {_FIRST}),' + _BATCH.format(b=1, cond=f"NOT {_FIRST}") + rules_sql("sc0", "f0", "a_", thr=JOB_THR) + ","
    + rules_sql("sc1", "flow", "b_", thr=JOB_THR) + "," + _NEW.format(p="a_") + "," + _NEW.format(p="b_")).replace("WITH ", "WITH RECURSIVE ", 1))
def scheduled_job_rules(spark, sf_dir):
    """Lines of the rule file after both batches: the first batch's rules in
    place, then what the second adds, each against the history so far."""
    return A.read_rules(spark, _run_job(spark, sf_dir).rules).select("line_no", "value").withColumnRenamed("value", "text")


@register("open_day_batch", "S4,L2,K7,J10", with_flow("""
SELECT event_id, src_ip, dest_port, strftime("timestamp", '%Y-%m-%d') AS day FROM flow
WHERE flow_id % 97 = 0 OR "timestamp" IS NULL OR CAST("timestamp" AS DATE) > (SELECT CAST(mid AS DATE) FROM cut)""", _CUT))
def open_day_batch(spark, sf_dir):
    """Events that wait after the days up to the middle were processed and
    closed and late events were stored behind: whole open days, and of the
    closed days that opened again only the late events."""
    d = materialize(_stored(spark, sf_dir).drop("_batch"))
    base = scratch_path(spark, "ledger")
    late = F.col("flow_id") % 97 == 0
    d.where(~late).write.partitionBy("event_date").parquet(f"{base}/store")
    ledger = Ledger(spark, f"{base}/ledger", f"{base}/store")
    ledger.mark(ledger.stored().where(F.col("event_date") <= F.to_date(F.lit(_mid(spark, sf_dir)))), 0, at="2024-01-01 00:00:00")
    ledger.close(0)
    d.where(late).write.mode("append").partitionBy("event_date").parquet(f"{base}/store")
    return ledger.pending().select("event_id", "src_ip", "dest_port", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
