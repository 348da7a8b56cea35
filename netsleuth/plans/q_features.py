"""Feature queries (A1-A7, W1-W4, F4-F8) over the flow view."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth.operators import features as FT
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.registry import register
from netsleuth.sources.flowview import flows


@register("ports_conn_per_src", "A1,A2", with_flow("""
SELECT f.event_id, f.src_ip, s.ports_used, s.conn_per_ip
FROM flow f JOIN (SELECT src_ip, count(DISTINCT dest_port)::BIGINT AS ports_used,
                         count(dest_ip)::BIGINT AS conn_per_ip
                  FROM flow GROUP BY src_ip) s USING (src_ip)"""))
def ports_conn_per_src(spark, sf_dir):
    d = FT.with_hour(flows(spark, sf_dir))
    return FT.add_source_features(d).select("event_id", "src_ip", "ports_used", "conn_per_ip")


@register("port_entropy", "A3,J3", with_flow("""
SELECT f.event_id, f.src_ip, coalesce(pe.port_entropy, 0.0) AS port_entropy
FROM flow f LEFT JOIN (
  SELECT src_ip, -sum((c / tot) * ln(c / tot + 1e-10)) AS port_entropy
  FROM (SELECT src_ip, dest_port, count(*)::DOUBLE AS c,
               sum(count(*)) OVER (PARTITION BY src_ip)::DOUBLE AS tot
        FROM flow WHERE dest_port IS NOT NULL GROUP BY src_ip, dest_port)
  GROUP BY src_ip) pe USING (src_ip)"""))
def port_entropy(spark, sf_dir):
    d = FT.with_hour(flows(spark, sf_dir))
    return FT.add_source_features(d).select("event_id", "src_ip", "port_entropy")


@register("failed_ratio_severity", "A4", with_flow("""
SELECT f.event_id, f.src_ip, s.failed_ratio
FROM flow f JOIN (SELECT src_ip, avg(CASE WHEN alert_severity > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS failed_ratio
                  FROM flow GROUP BY src_ip) s USING (src_ip)"""))
def failed_ratio_severity(spark, sf_dir):
    d = FT.with_hour(flows(spark, sf_dir))
    return FT.add_source_features(d).select("event_id", "src_ip", "failed_ratio")


@register("failed_ratio_rolling", "W1", with_flow("""
SELECT event_id, src_ip,
       avg(CASE WHEN tcp_flags_tc = 'S' THEN 1.0 ELSE 0.0 END) OVER (
         PARTITION BY src_ip ORDER BY "timestamp" NULLS FIRST, event_id
         ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::DOUBLE AS failed_ratio_rolling
FROM flow"""))
def failed_ratio_rolling(spark, sf_dir):
    return FT.failed_ratio_rolling(flows(spark, sf_dir)).select("event_id", "src_ip", "failed_ratio_rolling")


@register("hour_anomaly", "A5,J4,F6,F5", with_flow("""
SELECT h.event_id, h.src_ip, h.hour, h.is_night, m.modal_hour,
       CASE WHEN abs(h.hour - coalesce(m.modal_hour, 0)) > 3 THEN 1 ELSE 0 END AS hour_anomaly
FROM h LEFT JOIN (
  SELECT src_ip, hour AS modal_hour FROM (
    SELECT src_ip, hour, row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, hour ASC) AS rn
    FROM h GROUP BY src_ip, hour) WHERE rn = 1) m USING (src_ip)""", """
h AS (SELECT *, CAST(coalesce(hour("timestamp"), 0) AS INTEGER) AS hour,
             CASE WHEN coalesce(hour("timestamp"), 0) < 7 OR coalesce(hour("timestamp"), 0) > 20
                  THEN 1 ELSE 0 END AS is_night FROM flow)"""))
def hour_anomaly(spark, sf_dir):
    d = FT.with_hour(flows(spark, sf_dir))
    return FT.add_source_features(d).select("event_id", "src_ip", "hour", "is_night", "modal_hour",
                                            "hour_anomaly")


@register("conn_velocity", "W2", with_flow("""
SELECT event_id, src_ip, coalesce(avg(d) OVER (PARTITION BY src_ip ORDER BY "timestamp", event_id
                                                ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 1e6, 0.0) AS conn_velocity
FROM (SELECT *, epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (
                   PARTITION BY src_ip ORDER BY "timestamp", event_id) AS d
      FROM flow WHERE "timestamp" IS NOT NULL)
UNION ALL
SELECT event_id, src_ip, 0.0 AS conn_velocity FROM flow WHERE "timestamp" IS NULL"""))
def conn_velocity(spark, sf_dir):
    return FT.conn_velocity(flows(spark, sf_dir)).select("event_id", "src_ip", "conn_velocity")


@register("proto_stats_pkt_anomaly", "A6,J1,F7", with_flow("""
SELECT f.event_id, f.proto, f.packet_length, ps.proto_pkt_mean, ps.proto_pkt_std, ps.proto_ports,
       CASE WHEN abs(f.packet_length - ps.proto_pkt_mean) > 2 * ps.proto_pkt_std THEN 1 ELSE 0 END AS pkt_anomaly
FROM flow f LEFT JOIN (
  SELECT proto, avg(packet_length) AS proto_pkt_mean, stddev_samp(packet_length) AS proto_pkt_std,
         count(DISTINCT dest_port)::BIGINT AS proto_ports
  FROM flow WHERE proto IS NOT NULL GROUP BY proto) ps USING (proto)"""))
def proto_stats_pkt_anomaly(spark, sf_dir):
    d = FT.add_proto_features(flows(spark, sf_dir))
    return d.select("event_id", "proto", "packet_length", "proto_pkt_mean", "proto_pkt_std",
                    "proto_ports", "pkt_anomaly")


@register("rarity", "A7,J2,F8", with_flow("""
SELECT f.event_id, f.dest_port, f.dest_ip,
       1.0 / (1e-6 + coalesce(pf.fr, 0.0)) AS port_rarity,
       1.0 / (1e-6 + coalesce(df.fr, 0.0)) AS ip_rarity
FROM flow f
LEFT JOIN (SELECT dest_port, count(*)::DOUBLE / (SELECT count(dest_port) FROM flow) AS fr
           FROM flow WHERE dest_port IS NOT NULL GROUP BY dest_port) pf USING (dest_port)
LEFT JOIN (SELECT dest_ip, count(*)::DOUBLE / (SELECT count(dest_ip) FROM flow) AS fr
           FROM flow WHERE dest_ip IS NOT NULL GROUP BY dest_ip) df USING (dest_ip)"""))
def rarity(spark, sf_dir):
    return FT.add_rarity(flows(spark, sf_dir)).select("event_id", "dest_port", "dest_ip", "port_rarity",
                                                      "ip_rarity")


@register("conn_5m", "W3", with_flow("""
SELECT event_id, src_ip,
  CASE WHEN "timestamp" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us("timestamp")
       RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) END AS conn_5m,
  CASE WHEN "timestamp" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us("timestamp")
       RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) END AS conn_1d
FROM flow"""))
def conn_5m(spark, sf_dir):
    d = FT.conn_5m(flows(spark, sf_dir))
    d = FT.conn_5m(d, seconds=86_400, out_col="conn_1d")
    return d.select("event_id", "src_ip", "conn_5m", "conn_1d")


@register("proto_codes", "W4", with_flow("""
SELECT f.event_id, f.proto, coalesce(c.proto_code, -1) AS proto_code
FROM flow f LEFT JOIN (
  SELECT proto, CAST(dense_rank() OVER (ORDER BY proto) - 1 AS INTEGER) AS proto_code
  FROM (SELECT DISTINCT proto FROM flow WHERE proto IS NOT NULL)) c USING (proto)"""))
def proto_codes(spark, sf_dir):
    return FT.proto_codes(flows(spark, sf_dir)).select("event_id", "proto", "proto_code")
