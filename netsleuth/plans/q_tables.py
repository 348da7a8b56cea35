"""Table-level queries: the feature table, serving alignment, training
selection, unprocessed batches, sessions, log paging and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth.operators import explore as EX
from netsleuth.operators import features as FT
from netsleuth.operators import ingest as IG
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.q_ingest import _HASH_SQL, LINES_CTE, MODES_CTE
from netsleuth.plans.registry import register
from netsleuth.schemas import FEATURE_TABLE_COLUMNS, MODEL_FEATURES
from netsleuth.session import written
from netsleuth.sources.flowview import flows, lines_table, load_table, mode_log_table, with_model_prediction

_IP = ("CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 "
       "+ CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT)")

FEATURES_CTE = """
fh AS (SELECT *, CAST(coalesce(hour("timestamp"), 0) AS INTEGER) AS hour FROM flow),
src AS (SELECT src_ip, count(DISTINCT dest_port)::BIGINT AS ports_used, count(dest_ip)::BIGINT AS conn_per_ip,
               avg(CASE WHEN alert_severity > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS failed_ratio FROM fh GROUP BY src_ip),
ent AS (SELECT src_ip, -sum((c / tot) * ln(c / tot + 1e-10)) AS port_entropy
        FROM (SELECT src_ip, dest_port, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY src_ip)::DOUBLE AS tot
              FROM fh WHERE dest_port IS NOT NULL GROUP BY src_ip, dest_port) GROUP BY src_ip),
modal AS (SELECT src_ip, hour AS modal_hour FROM (
            SELECT src_ip, hour, row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, hour ASC) AS rn
            FROM fh GROUP BY src_ip, hour) WHERE rn = 1),
vel AS (SELECT event_id, coalesce(avg(d) OVER (PARTITION BY src_ip ORDER BY "timestamp", event_id
                                              ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 1e6, 0.0) AS conn_velocity
        FROM (SELECT *, epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (
                            PARTITION BY src_ip ORDER BY "timestamp", event_id) AS d
              FROM fh WHERE "timestamp" IS NOT NULL)
        UNION ALL SELECT event_id, 0.0 FROM fh WHERE "timestamp" IS NULL),
c5 AS (SELECT event_id, CASE WHEN "timestamp" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY src_ip
              ORDER BY epoch_us("timestamp") RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) END AS conn_5m FROM fh),
ps AS (SELECT proto, avg(packet_length) AS proto_pkt_mean, stddev_samp(packet_length) AS proto_pkt_std,
              count(DISTINCT dest_port)::BIGINT AS proto_ports FROM fh WHERE proto IS NOT NULL GROUP BY proto),
pf AS (SELECT dest_port, count(*)::DOUBLE / (SELECT count(dest_port) FROM fh) AS fr FROM fh
       WHERE dest_port IS NOT NULL GROUP BY dest_port),
df AS (SELECT dest_ip, count(*)::DOUBLE / (SELECT count(dest_ip) FROM fh) AS fr FROM fh
       WHERE dest_ip IS NOT NULL GROUP BY dest_ip),
codes AS (SELECT proto, CAST(dense_rank() OVER (ORDER BY proto) - 1 AS INTEGER) AS proto_code
          FROM (SELECT DISTINCT proto FROM fh WHERE proto IS NOT NULL)),
ft AS (
  SELECT CAST(""" + _IP.format(c="f.src_ip") + """ AS DOUBLE) AS src_ip,
         CAST(""" + _IP.format(c="f.dest_ip") + """ AS DOUBLE) AS dest_ip,
         coalesce(codes.proto_code, -1) AS proto, f.src_port, f.dest_port, f.alert_severity, f.packet_length, f.hour,
         CASE WHEN f.hour < 7 OR f.hour > 20 THEN 1 ELSE 0 END AS is_night,
         src.ports_used, src.conn_per_ip,
         1.0 / (1e-6 + coalesce(pf.fr, 0.0)) AS port_rarity, 1.0 / (1e-6 + coalesce(df.fr, 0.0)) AS ip_rarity,
         c5.conn_5m, coalesce(ent.port_entropy, 0.0) AS port_entropy, src.failed_ratio,
         CASE WHEN abs(f.hour - coalesce(modal.modal_hour, 0)) > 3 THEN 1 ELSE 0 END AS hour_anomaly,
         vel.conn_velocity, ps.proto_pkt_mean, ps.proto_pkt_std, ps.proto_ports,
         CASE WHEN abs(f.packet_length - ps.proto_pkt_mean) > 2 * ps.proto_pkt_std THEN 1 ELSE 0 END AS pkt_anomaly,
         CASE WHEN f.training_mode AND f.training_label = 'anomaly' THEN 1
              WHEN f.training_mode AND f.training_label = 'normal' THEN 0 ELSE -1 END AS anomaly,
         f.event_id, f.training_label
  FROM fh f JOIN src USING (src_ip) LEFT JOIN ent USING (src_ip) LEFT JOIN modal USING (src_ip)
       JOIN vel USING (event_id) JOIN c5 USING (event_id) LEFT JOIN ps USING (proto)
       LEFT JOIN pf USING (dest_port) LEFT JOIN df USING (dest_ip) LEFT JOIN codes USING (proto))
"""

FEATURE_COLS = FEATURE_TABLE_COLUMNS + ["training_label"]


def feature_frame(spark, sf_dir):
    return FT.features(flows(spark, sf_dir))


@register("feature_table", "P4,P5", with_flow("SELECT * FROM ft", FEATURES_CTE))
def feature_table(spark, sf_dir):
    return feature_frame(spark, sf_dir).select(*FEATURE_COLS)


_INGESTED = LINES_CTE + "," + MODES_CTE + """,
ing AS (SELECT DISTINCT """ + _HASH_SQL + """ AS event_id, l_ts AS "timestamp", src_ip, dest_ip, proto, l_src_port AS src_port,
               l_dest_port AS dest_port, packet_length, l_alert_severity AS alert_severity, l_training_mode AS training_mode,
               l_training_label AS training_label,
               CAST(CASE WHEN l_ts IS NULL THEN 0 WHEN flow_id % 3 = 0 THEN hour(l_ts + INTERVAL 2 HOUR)
                         ELSE hour(l_ts) END AS INTEGER) AS hour FROM admitted),
fh AS (SELECT * FROM ing),
""" + FEATURES_CTE.split("\n", 2)[2]


@register("ingested_features", "S1,P1,P2,P3,P4,P5,F4,F12,A4", with_flow("SELECT * FROM ft", _INGESTED))
def ingested_features(spark, sf_dir):
    """Raw lines (mixed offsets, malformed ones among them) -> ingest with the
    mode log -> feature table."""
    stored = IG.ingest(lines_table(spark, sf_dir), mode_log_table(spark, sf_dir))
    return FT.features(written(stored, "ingested")).select(*FEATURE_COLS)


@register("train_selection", "P8,P9", with_flow(
    "SELECT event_id, " + ", ".join(MODEL_FEATURES) + " FROM ft WHERE lower(training_label) = 'normal'", FEATURES_CTE))
def train_selection(spark, sf_dir):
    return EX.training_rows(feature_frame(spark, sf_dir))


@register("coerce_align", "P6,P7,F1", with_flow(
    "SELECT event_id, " + ", ".join(
        (f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}" if c in ("proto", "src_port", "dest_port", "alert_severity",
                                                                    "packet_length") else f"0.0::DOUBLE AS {c}")
        for c in MODEL_FEATURES) + " FROM flow"))
def coerce_align(spark, sf_dir):
    serving = flows(spark, sf_dir).select("event_id", "src_ip", "dest_ip", "proto", "src_port", "dest_port",
                                          "alert_severity", "packet_length", "timestamp")
    return EX.align_features(serving)


_CUT = "cut AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS mid FROM events)"


def _mid(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(F.timestamp_micros(F.floor((F.min(us) + F.max(us)) / 2).cast("long"))).scalar()


@register("unprocessed_batch", "S4,L2,K7,J10", with_flow("""
SELECT event_id, src_ip, dest_ip, proto, src_port, dest_port, alert_severity, packet_length,
       CAST("timestamp" AS TIMESTAMP) AS "timestamp"
FROM flow WHERE event_id NOT IN (SELECT event_id FROM flow WHERE "timestamp" < (SELECT mid FROM cut))
ORDER BY "timestamp" NULLS FIRST, event_id LIMIT 100""", _CUT))
def unprocessed_batch(spark, sf_dir):
    f = flows(spark, sf_dir)
    ledger = EX.mark_processed(f.where(F.col("timestamp") < _mid(spark, sf_dir)), at="2024-01-01 00:00:00")
    b = EX.unprocessed(f, ledger, 100)
    return b.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("latest_session", "A11,L5", with_flow("""
SELECT training_session, n_events, last_ts,
       training_session = (SELECT training_session FROM s ORDER BY last_ts DESC, training_session DESC LIMIT 1) AS is_latest
FROM s""", """
s AS (SELECT training_session, count(*) AS n_events, max("timestamp") AS last_ts FROM flow
      WHERE training_mode AND training_session IS NOT NULL GROUP BY training_session)"""))
def latest_session(spark, sf_dir):
    s = EX.sessions(flows(spark, sf_dir))
    return s.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@register("logs_by_day_page", "P16,L1,F20", with_flow("""
SELECT flow_id, timestamp_raw, l_event_type AS event_type, 2 AS page, 100 AS "limit",
       (SELECT count(*) FROM d) AS total
FROM d ORDER BY l_ts DESC NULLS LAST, flow_id DESC LIMIT 100 OFFSET 100""", LINES_CTE + """,
d AS (SELECT * FROM lines WHERE l_ts IS NOT NULL AND CAST(substr(timestamp_raw, 1, 10) AS DATE) = DATE '2024-01-10')"""))
def logs_by_day_page(spark, sf_dir):
    ev = IG.flatten(IG.parse_lines(lines_table(spark, sf_dir)))
    return EX.logs_by_day(ev, "2024-01-10", page=2, limit=100).select(
        "flow_id", "timestamp_raw", "event_type", "page", "limit", "total")


@register("dashboard_stats", "A14", with_flow("""
SELECT count(*) AS total_events, count(*) FILTER (WHERE prediction = -1) AS anomalies_detected,
       count(*) FILTER (WHERE prediction = -1) * 100.0 / count(*) AS anomaly_percentage FROM scored"""))
def dashboard_stats(spark, sf_dir):
    return EX.dashboard(with_model_prediction(flows(spark, sf_dir)))


@register("top_sources", "A15", with_flow("""
SELECT src_ip, count(*) AS count FROM scored WHERE prediction = -1
GROUP BY src_ip ORDER BY count DESC, src_ip ASC LIMIT 5"""))
def top_sources(spark, sf_dir):
    return EX.top_sources(with_model_prediction(flows(spark, sf_dir)))
