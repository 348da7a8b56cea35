"""Streaming queries: run the stream to completion (``availableNow``) over
stand-in files derived from ``events`` and return the sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.q_ingest import LINES_CTE, MODES_CTE, _HASH_SQL
from netsleuth.plans.registry import register
from netsleuth.session import scratch_path
from netsleuth.sources.flowview import flows, mode_log_table, raw_line_files
from netsleuth.streaming import ingest as SI
from netsleuth.streaming import windows as SW

_COLS = ["event_hash", "event_type", "timestamp_raw", "flow_id", "src_ip", "dest_ip", "proto", "src_port",
         "dest_port", "training_label", "anomaly"]


@register("stream_ingest", "T1,T2,T3,T5,K1,S1", with_flow("""
SELECT DISTINCT """ + _HASH_SQL + """ AS event_hash, l_event_type AS event_type, timestamp_raw, flow_id, src_ip,
       dest_ip, proto, l_src_port AS src_port, l_dest_port AS dest_port, l_training_label AS training_label,
       l_anomaly AS anomaly
FROM admitted""", LINES_CTE + "," + MODES_CTE))
def stream_ingest(spark, sf_dir):
    """The sensor-log folder streamed in 4 micro-batches (2 files each); the
    stored table then holds every admitted event exactly once."""
    src = raw_line_files(spark, sf_dir)
    stored, ckpt = scratch_path(spark, "stored-events"), scratch_path(spark, "ingest-ckpt")
    q = SI.start_ingest(spark, src, stored, ckpt, modes=mode_log_table(spark, sf_dir), trigger={"availableNow": True},
                        max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(stored).select(*_COLS)


@register("stream_conn_window", "T6", with_flow("""
SELECT w.window_start, w.window_start + INTERVAL 5 MINUTE AS window_end, w.src_ip, count(*) AS n
FROM (SELECT src_ip, time_bucket(INTERVAL 1 MINUTE, "timestamp") - to_minutes(k) AS window_start
      FROM flow, range(5) r(k) WHERE "timestamp" IS NOT NULL) w
GROUP BY w.window_start, w.src_ip"""))
def stream_conn_window(spark, sf_dir):
    """Sliding 5-minute / 1-minute counts per source over the flow records
    streamed from Parquet files (append mode); a closing marker behind the last
    file releases the windows that the watermark still holds."""
    def start(events, out, ckpt):
        return SW.start_sliding_counts(events, out, ckpt, trigger={"availableNow": True})
    return _whole_stream(spark, sf_dir, "conn-windows", start).where("src_ip is not null") \
        .withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
        .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def _whole_stream(spark, sf_dir, name, start):
    """Run a stream over the flow records and then over the closing marker."""
    src, out, ckpt = scratch_path(spark, "flow-files"), scratch_path(spark, name), scratch_path(spark, f"{name}-ckpt")
    flows(spark, sf_dir).repartition(max(4, spark.sparkContext.defaultParallelism)).write.parquet(src)
    stored = spark.read.parquet(src)
    schema = stored.schema
    start(spark.readStream.schema(schema).parquet(src), out, ckpt).awaitTermination()
    newest = stored.agg(F.max("timestamp")).first()[0]
    SW.closing_marker(spark, schema, newest).write.mode("append").parquet(src)
    start(spark.readStream.schema(schema).parquet(src), out, ckpt).awaitTermination()
    return spark.read.parquet(out)


@register("stream_conn_5m_exact", "T6,W3", with_flow("""
SELECT event_id, src_ip, "timestamp", CASE WHEN "timestamp" IS NULL THEN 0 ELSE
       count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us("timestamp") RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) END AS conn_5m
FROM flow"""))
def stream_conn_5m_exact(spark, sf_dir):
    """Exact trailing 5-minute count of every event on a stream (stateful)."""
    def start(events, out, ckpt):
        with SW.keyed_state(spark):
            return (SW.exact_trailing_counts(events).writeStream.outputMode("append").format("parquet")
                    .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    return _whole_stream(spark, sf_dir, "conn5m-exact", start).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
