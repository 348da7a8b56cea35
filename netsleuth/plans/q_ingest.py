"""Ingest queries over sensor-style JSON lines derived from ``events``:
flatten (P2), mode lookup (J9, P3, F9, F10), admission (P1), hashing and
de-duplication (F11, K1, J8), fallback ids (F12), IP numbers (F1, F3) and
wall-clock hours (F4, F5, F20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsleuth.functions.clock import is_night, wall_clock_hour
from netsleuth.functions.ip import ipv4_to_int
from netsleuth.operators import ingest as IG
from netsleuth.operators.modes import attach_mode
from netsleuth.plans.oracle_sql import with_flow
from netsleuth.plans.registry import register
from netsleuth.session import written
from netsleuth.sources.flowview import lines_table, load_table, mode_log_table

LINES_CTE = """
lines AS (
  SELECT f.*, c.copy,
    CASE WHEN f.flow_id % 23 = 7 THEN 'stats' ELSE f.event_type END AS l_event_type,
    CASE WHEN f.flow_id % 97 = 5 THEN 'Desconocido'
         WHEN f.flow_id % 3 = 0 THEN strftime(f."timestamp" + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+0200'
         ELSE strftime(f."timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+0000' END AS timestamp_raw,
    CASE WHEN f.flow_id % 97 = 5 THEN NULL ELSE f."timestamp" END AS l_ts,
    CASE WHEN f.flow_id % 97 = 5 THEN NULL WHEN f.flow_id % 3 = 0 THEN '+0200' ELSE '+0000' END AS utc_offset,
    CASE WHEN f.proto = 'ICMP' THEN 0 ELSE f.src_port END AS l_src_port,
    CASE WHEN f.proto = 'ICMP' THEN 0 ELSE f.dest_port END AS l_dest_port,
    CASE WHEN f.event_type = 'alert' THEN f.alert_severity ELSE 0 END AS l_alert_severity,
    CASE WHEN f.event_type = 'alert' AND f.flow_id % 5 <> 0
         THEN 'sig-' || CAST(f.flow_id % 13 AS VARCHAR) ELSE 'Sin firma' END AS alert_signature,
    CASE WHEN f.event_type = 'dns' THEN 'host' || CAST(f.flow_id % 17 AS VARCHAR) || '.example' END AS dns_query,
    CASE WHEN f.event_type = 'flow' AND f.flow_id % 2 = 1
         THEN 'tls' || CAST(f.flow_id % 5 AS VARCHAR) || '.example' END AS tls_sni,
    CASE WHEN f.event_type = 'http' THEN 'web' || CAST(f.flow_id % 7 AS VARCHAR) || '.example' END AS http_hostname,
    CASE WHEN f.event_type = 'http' THEN '/p/' || CAST(f.flow_id % 29 AS VARCHAR) END AS http_url
  FROM flow f JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR f.flow_id % 19 = 0)
"""

MODES_CTE = """
mraw AS (
  SELECT ts AS effective_from,
    CASE event_id % 5 WHEN 0 THEN ' Normal' WHEN 1 THEN 'anomaly' WHEN 2 THEN 'OFF' END AS m,
    CASE event_id % 5 WHEN 3 THEN true WHEN 4 THEN false END AS v,
    CASE WHEN user_id % 2 = 0 THEN 'Anomaly' ELSE 'normal' END AS lab,
    CASE WHEN event_id % 3 = 0 THEN substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) END AS sh
  FROM b WHERE k IN (0, 1)),
mnorm AS (
  SELECT effective_from, sh,
    CASE WHEN lower(trim(m)) IN ('normal', 'anomaly', 'off') THEN lower(trim(m))
         WHEN coalesce(v, false) AND lower(trim(lab)) IN ('normal', 'anomaly') THEN lower(trim(lab))
         ELSE 'off' END AS mode
  FROM mraw),
mlog AS (
  SELECT effective_from, mode,
    CASE WHEN mode IN ('normal', 'anomaly')
         THEN coalesce(sh, mode || '-' || strftime(effective_from, '%Y%m%d-%H%M')) END AS session
  FROM mnorm),
labelled AS (
  SELECT l.*, coalesce(m.mode, 'off') AS mode,
    coalesce(m.mode, 'off') IN ('normal', 'anomaly') AS l_training_mode,
    CASE WHEN coalesce(m.mode, 'off') IN ('normal', 'anomaly') THEN m.mode ELSE 'unknown' END AS l_training_label,
    CASE WHEN coalesce(m.mode, 'off') IN ('normal', 'anomaly') THEN m.session END AS l_training_session,
    CASE WHEN m.mode = 'anomaly' THEN 1 ELSE 0 END AS l_anomaly
  FROM lines l ASOF LEFT JOIN mlog m ON l.l_ts >= m.effective_from),
admitted AS (
  SELECT * FROM labelled
  WHERE (l_training_mode AND l_event_type <> 'stats') OR (NOT l_training_mode AND l_event_type = 'alert'))
"""


def _lines(spark, sf_dir):
    return lines_table(spark, sf_dir)


def _flat(spark, sf_dir):
    return IG.flatten(IG.parse_lines(_lines(spark, sf_dir)))


def _labelled(spark, sf_dir):
    flat = IG.flatten(IG.parse_lines(lines_table(spark, sf_dir)))
    return IG.label(attach_mode(flat, mode_log_table(spark, sf_dir)))


@register("flow_flatten", "S1,P2,F18,F20", with_flow("""
SELECT l_event_type AS event_type, timestamp_raw, l_ts AS "timestamp", utc_offset, flow_id, proto, src_ip,
       l_src_port AS src_port, dest_ip, l_dest_port AS dest_port, packet_length,
       l_alert_severity AS alert_severity, alert_signature, dns_query, tls_sni, http_hostname, http_url,
       CAST(NULL AS VARCHAR) AS file_magic, CAST(NULL AS VARCHAR) AS file_mime
FROM lines""", LINES_CTE))
def flow_flatten(spark, sf_dir):
    f = _flat(spark, sf_dir)
    return f.drop("tcp_flags", "tcp_flags_tc").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("quarantine_lines", "S1", with_flow("""
SELECT CASE event_id % 41 WHEN 1 THEN s || ',"timest' WHEN 2 THEN s || '}trailing' WHEN 3 THEN '[' || s || '}]'
            WHEN 4 THEN s || '} ' || s || '}' WHEN 5 THEN CAST(event_id AS VARCHAR) ELSE s || '}}' END AS value
FROM (SELECT event_id, '{"event_type":"alert","flow_id":' || CAST(event_id AS VARCHAR) AS s FROM events)
WHERE event_id % 41 BETWEEN 1 AND 6"""))
def quarantine_lines(spark, sf_dir):
    """Every malformed line of the log, and no other."""
    return IG.quarantine(IG.parse_lines(_lines(spark, sf_dir)))


@register("mode_label_asof", "J9,P3,F9,F10,S12", with_flow("""
SELECT flow_id, l_ts AS "timestamp", mode, l_training_mode AS training_mode, l_training_label AS training_label,
       l_training_session AS training_session, l_anomaly AS anomaly
FROM labelled""", LINES_CTE + "," + MODES_CTE))
def mode_label_asof(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return d.select("flow_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "mode",
                    "training_mode", "training_label", "training_session", "anomaly")


@register("admission_filter", "P1", with_flow("""
SELECT flow_id, l_event_type AS event_type, l_training_mode AS training_mode FROM admitted""", LINES_CTE + "," + MODES_CTE))
def admission_filter(spark, sf_dir):
    return IG.admit(_labelled(spark, sf_dir)).select("flow_id", "event_type", "training_mode")


_HASH_SQL = """sha256(concat_ws('|', coalesce(l_event_type, 'None'), timestamp_raw, src_ip, dest_ip, proto,
    CAST(l_src_port AS VARCHAR), CAST(l_dest_port AS VARCHAR), coalesce(CAST(flow_id AS VARCHAR), 'None'),
    alert_signature, coalesce(dns_query, 'None'), coalesce(tls_sni, 'None'), coalesce(http_hostname, 'None'),
    coalesce(http_url, 'None')))"""


@register("event_hash_dedup", "F11,K1,J8,T2", with_flow(f"""
SELECT DISTINCT h.event_hash, h.event_type, h.timestamp_raw, h.flow_id, h.src_ip, h.dest_ip, h.proto,
       h.src_port, h.dest_port, h.training_label, h.anomaly
FROM hashed h
WHERE h.event_hash NOT IN (SELECT event_hash FROM hashed WHERE l_ts < (SELECT mid FROM cut))""",
  LINES_CTE + "," + MODES_CTE + f""",
cut AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS mid FROM events),
hashed AS (SELECT {_HASH_SQL} AS event_hash, l_event_type AS event_type, timestamp_raw, flow_id, src_ip,
                  dest_ip, proto, l_src_port AS src_port, l_dest_port AS dest_port,
                  l_training_label AS training_label, l_anomaly AS anomaly, l_ts FROM admitted)"""))
def event_hash_dedup(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    lines, modes = lines_table(spark, sf_dir), mode_log_table(spark, sf_dir)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = ev.select(F.timestamp_micros(F.floor((F.min(us) + F.max(us)) / 2).cast("long"))).scalar()
    flat = written(IG.flatten(IG.parse_lines(lines)), "flat-lines")       # the store's rows and the batch come from one parse
    stored = _ingest_flat(flat.where(F.col("timestamp") < mid), modes)
    new = IG.ingest_flat(flat, modes, stored_keys=stored.select("event_date", "event_hash"))
    return new.select("event_hash", "event_type", "timestamp_raw", "flow_id", "src_ip", "dest_ip", "proto",
                      "src_port", "dest_port", "training_label", "anomaly")


def _ingest_flat(flat, modes):
    """The ingest path from already flattened rows (stored-table stand-in)."""
    labelled = IG.label(attach_mode(flat, modes))
    return IG.dedup_new(IG.with_event_hash(IG.admit(labelled)), None)


@register("event_id_fallback", "F12", with_flow("""
SELECT flow_id, md5(concat_ws('-', src_ip, dest_ip, timestamp_raw)) AS event_id FROM lines""", LINES_CTE))
def event_id_fallback(spark, sf_dir):
    return IG.with_fallback_id(_flat(spark, sf_dir)).select("flow_id", "event_id")


_IPV4_RE = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


@register("ip_to_int", "F1,F3", with_flow(f"""
SELECT event_id, kind, ip,
  CASE WHEN regexp_full_match(ip, '{_IPV4_RE}')
       THEN CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
          + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT)
       ELSE 0 END AS ip_int
FROM (SELECT event_id, 'src' AS kind, src_ip AS ip FROM flow
      UNION ALL SELECT event_id, 'dest', dest_ip FROM flow
      UNION ALL SELECT f.event_id, 'octet', CAST(b.user_id % 300 AS VARCHAR) || '.1.1.1'
                FROM flow f JOIN b ON CAST(b.event_id AS VARCHAR) = f.event_id
      UNION ALL SELECT f.event_id, 'lead0', '0' || CAST(b.user_id % 16 AS VARCHAR) || '.2.3.4'
                FROM flow f JOIN b ON CAST(b.event_id AS VARCHAR) = f.event_id)"""))
def ip_to_int(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    cands = ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.explode(F.array(
            F.struct(F.lit("src").alias("kind"), F.concat(F.lit("10.0."), (F.col("user_id") % 16).cast("string"),
                                                          F.lit("."), (F.col("user_id") % 251).cast("string")).alias("ip")),
            F.struct(F.lit("dest").alias("kind"), F.concat(F.lit("192.168.10."),
                                                           (F.floor("value").cast("int") % 40).cast("string")).alias("ip")),
            F.struct(F.lit("octet").alias("kind"), F.concat((F.col("user_id") % 300).cast("string"), F.lit(".1.1.1")).alias("ip")),
            F.struct(F.lit("lead0").alias("kind"), F.concat(F.lit("0"), (F.col("user_id") % 16).cast("string"),
                                                            F.lit(".2.3.4")).alias("ip")),
        )).alias("c"))
    return cands.select("event_id", "c.kind", "c.ip", ipv4_to_int("c.ip").alias("ip_int"))


@register("hour_night", "F4,F5,F20", with_flow("""
SELECT flow_id, timestamp_raw, hour, CASE WHEN hour < 7 OR hour > 20 THEN 1 ELSE 0 END AS is_night
FROM (SELECT flow_id, timestamp_raw,
        CAST(CASE WHEN l_ts IS NULL THEN 0 WHEN flow_id % 3 = 0 THEN hour(l_ts + INTERVAL 2 HOUR)
                  ELSE hour(l_ts) END AS INTEGER) AS hour FROM lines)""", LINES_CTE))
def hour_night(spark, sf_dir):
    f = _flat(spark, sf_dir)
    return f.select("flow_id", "timestamp_raw", wall_clock_hour("timestamp_raw").alias("hour")) \
            .withColumn("is_night", is_night("hour"))
