"""Stored artefacts written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsleuth import constants as K
from netsleuth.operators import evaluate as EV
from netsleuth.operators import explore as EX
from netsleuth.operators import ingest as IG
from netsleuth.operators import iforest as IF
from netsleuth.operators import thresholds as TH
from netsleuth.operators.ledger import Ledger
from netsleuth.operators.modes import attach_mode
from netsleuth.plans import detect as D
from netsleuth.plans import job as J
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.q_detect import fixed_forest
from netsleuth.plans.q_ingest import LINES_CTE
from netsleuth.plans.q_model import EVAL_CTE, MP_GRID, PCT, SESSION, _joined, _scored, _selected_threshold, _sweep_sql
from netsleuth.plans.q_tables import _CUT, FEATURES_CTE, feature_frame
from netsleuth.plans.registry import ORACLE, register
from netsleuth.schemas import FEATURE_TABLE_COLUMNS, MODE_LOG
from netsleuth.session import materialize, scratch_path
from netsleuth.sources import artifacts as A
from netsleuth.sources import events as E
from netsleuth.sources.flowview import flows, load_table, raw_line_files


@register("recent_lines", "S2,S1", with_flow("""
SELECT flow_id, timestamp_raw, l_event_type AS event_type FROM lines ORDER BY l_ts DESC NULLS LAST, timestamp_raw DESC LIMIT 1000""", LINES_CTE))
def recent_lines(spark, sf_dir):
    """The newest 1,000 lines of the log folder."""
    return E.recent_lines(spark, raw_line_files(spark, sf_dir), n=1000).select("flow_id", "timestamp_raw", "event_type")


@register("stored_session_scan", "S3,S5,K1,L2", with_flow("""
SELECT event_id, src_ip, training_label FROM flow WHERE training_mode AND training_session = 'session-b'
ORDER BY "timestamp" NULLS FIRST, event_id LIMIT 1000"""))
def stored_session_scan(spark, sf_dir):
    """The oldest 1,000 events of one session, scanned from the stored table."""
    path = scratch_path(spark, "stored")
    E.write_stored(flows(spark, sf_dir), path)
    return E.stored_events(spark, path, training_session="session-b", max_rows=1000).select("event_id", "src_ip", "training_label")


@register("log_cursor_pages", "L1,P16", with_flow("""
SELECT event_id FROM flow WHERE CAST("timestamp" AS DATE) = DATE '2024-01-10' ORDER BY "timestamp" DESC, flow_id DESC LIMIT 300"""))
def log_cursor_pages(spark, sf_dir):
    """Three pages of a day's log, each behind the cursor of the one before."""
    ev = IG.with_event_date(flows(spark, sf_dir)).withColumn("timestamp_raw", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx"))
    path = scratch_path(spark, "log")
    ev.write.partitionBy("event_date").parquet(path)
    stored, cursor, pages = spark.read.parquet(path), None, []
    for _ in range(3):
        page = materialize(EX.logs_after(stored, "2024-01-10", cursor, limit=100).select("event_id", "timestamp", "flow_id"))
        cursor = EX.cursor_of(page) or cursor
        pages.append(page.select("event_id"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


_FEATURE_CSV = T.StructType([T.StructField(c, T.StringType() if c == "event_id" else T.DoubleType()) for c in FEATURE_TABLE_COLUMNS])


@register("feature_file_preview", "K2,S6,S8,S13,L4", with_flow(
    "SELECT event_id, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in FEATURE_TABLE_COLUMNS if c != "event_id") + " FROM ft ORDER BY event_id LIMIT 50",
    FEATURES_CTE))
def feature_file_preview(spark, sf_dir):
    """The feature table written, read back as CSV with text ids beside an
    absent history file, and previewed."""
    path = scratch_path(spark, "features")
    A.write_table(feature_frame(spark, sf_dir).select(*FEATURE_TABLE_COLUMNS), path, csv=True)
    now = A.table_or_empty(spark, path + "_csv", _FEATURE_CSV, fmt="csv")
    past = A.table_or_empty(spark, path + "_history", _FEATURE_CSV)
    return EX.preview(now.unionByName(past), 50)


@register("score_and_truth_files", "K3,K4,S7,J5,P11", with_flow("SELECT event_id, anomaly_score, prediction_bin, gt_label FROM j", EVAL_CTE))
def score_and_truth_files(spark, sf_dir):
    """Scores and ground truth written as CSV and joined as they are read back."""
    base = scratch_path(spark, "evaluation")
    A.write_table(_scored(spark, sf_dir).select("event_id", "anomaly_score", "prediction"), base + "/scores", csv=True)
    A.write_table(EV.ground_truth(flows(spark, sf_dir), SESSION).select("event_id", "prediction_g", "training_label"), base + "/truth", csv=True)
    scores = A.table_or_empty(spark, base + "/scores_csv", T._parse_datatype_string("event_id string, anomaly_score double, prediction int"), fmt="csv")
    truth = A.table_or_empty(spark, base + "/truth_csv", T._parse_datatype_string("event_id string, prediction_g int, training_label string"), fmt="csv")
    return EV.join_scores(scores, truth).select("event_id", "anomaly_score", "prediction_bin", "gt_label")


@register("threshold_files", "K5,S11,M7", with_flow(
    f"SELECT threshold, {K.ANOMALY_THRESHOLD}::DOUBLE AS without_files FROM sel", EVAL_CTE + "," + _sweep_sql(MP_GRID, K.MIN_PRECISION_FOR_THRESHOLD, PCT)))
def threshold_files(spark, sf_dir):
    """The selected threshold as the job reads it back, and the default that
    it takes where no file is."""
    path = scratch_path(spark, "thresholds")
    A.write_thresholds(TH.best_threshold(_joined(spark, sf_dir), grid=MP_GRID, min_precision=K.MIN_PRECISION_FOR_THRESHOLD), path)
    return spark.range(1).select(F.lit(A.read_threshold(spark, path)).alias("threshold"),
                                 F.lit(float(A.read_threshold(spark, path + "-none"))).alias("without_files"))


@register("mode_log_appends", "K8,S12,J9,A12", with_flow("""
SELECT mode, session, count(*) AS n FROM (
  SELECT CASE WHEN "timestamp" >= hi THEN 'off' WHEN "timestamp" >= mid THEN 'anomaly' WHEN "timestamp" >= lo THEN 'normal' ELSE 'off' END AS mode,
         CASE WHEN "timestamp" >= lo AND "timestamp" < hi THEN 'one-session' END AS session
  FROM flow, (SELECT min(ts) AS lo, max(ts) AS hi FROM events), cut) GROUP BY mode, session""", _CUT))
def mode_log_appends(spark, sf_dir):
    """Events by the mode that was switched on at the first event, in the
    middle, and off at the last; one session is kept across the switch."""
    t = load_table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    us = t.select(F.unix_micros(F.col("lo").cast("timestamp")).alias("lo"), F.unix_micros(F.col("hi").cast("timestamp")).alias("hi")).first()
    path = scratch_path(spark, "modes")
    stamp = lambda x: F.timestamp_micros(F.lit(x))
    A.append_mode(spark, path, K.MODE_NORMAL, "one-session", at=stamp(us["lo"]))
    A.append_mode(spark, path, K.MODE_ANOMALY, at=stamp((us["lo"] + us["hi"]) // 2))
    A.append_mode(spark, path, K.MODE_OFF, at=stamp(us["hi"]))
    return attach_mode(flows(spark, sf_dir), spark.read.schema(MODE_LOG).parquet(path)).groupBy("mode", "session").agg(F.count(F.lit(1)).alias("n"))


@register("saved_forest_score", "K10,M3,M4", ORACLE["forest_fixed_score"])
def saved_forest_score(spark, sf_dir):
    """Every event scored by a node table that was saved and loaded."""
    path = scratch_path(spark, "forest")
    fixed_forest().save(spark, path)
    s = IF.IsolationForestModel.load(spark, path).score(flows(spark, sf_dir).drop("anomaly_score"))
    return s.select("event_id", F.round("anomaly_score", 9).alias("anomaly_score"), "prediction")


@register("miss_files", "K9,L3,M8", ORACLE["fn_fp_samples"])
def miss_files(spark, sf_dir):
    """The worst misses as they are read back from their files."""
    path = scratch_path(spark, "misses")
    j, thr = _selected_threshold(spark, sf_dir)
    A.write_misses(EV.fn_fp_samples(j, thr).select("kind", "event_id", "anomaly_score", "gt_label", "proto", "dest_port"), path)
    fn, fp = (spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("kind"), "*") for k in ("fn", "fp"))
    return fn.unionByName(fp)


@register("scheduled_stream", "T4,T5,M10,K3,K7", ORACLE["scheduled_job_sinks"].replace(
    "SELECT CASE WHEN coalesce(\"timestamp\" < (SELECT mid FROM cut), true) THEN 0 ELSE 1 END AS batch, event_id", "SELECT event_id"))
def scheduled_stream(spark, sf_dir):
    """The rule job as a scheduled stream over the stored events: scores of
    every event, and how often each is in the score and the ledger sink."""
    f = IG.with_event_date(flows(spark, sf_dir).drop("anomaly_score"))
    base = scratch_path(spark, "job-stream")
    paths = J.JobPaths(*[f"{base}/{n}" for n in ("store", "state", "scores", "rules", "ledger")])
    for part in (F.col("flow_id") % 2 == 0, F.col("flow_id") % 2 == 1):
        f.where(part).coalesce(2).write.mode("append").partitionBy("event_date").parquet(paths.store)
        schema = spark.read.parquet(paths.store).schema
        J.start_job(spark, paths, D.Detector({}, fixed_forest(), {}), schema, f"{base}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    once = J.scores(spark, paths).groupBy("event_id").agg(F.max("anomaly_score").alias("s"), F.max("prediction").alias("prediction"),
                                                          F.count(F.lit(1)).cast("int").alias("n_scores"))
    ledger = Ledger(spark, paths.ledger, paths.store).rows().groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("n_ledger"))
    return once.join(ledger, "event_id", "full").select("event_id", F.round("s", 9).alias("anomaly_score"), "prediction", "n_scores", "n_ledger")
