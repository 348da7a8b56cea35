"""Declared schemas: one explicit StructType per table."""

from pyspark.sql import types as T

# Raw sensor line (JSON).  ``packet`` is kept as text: the sensor writes either
# an object with ``length`` or a Base64 dump, and a STRUCT type would flag the
# whole line as corrupt for the Base64 form.
RAW_EVENT = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("flow_id", T.LongType()),
    T.StructField("proto", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.IntegerType()),
    T.StructField("packet", T.StringType()),
    T.StructField("alert", T.StructType([
        T.StructField("severity", T.IntegerType()),
        T.StructField("signature", T.StringType()),
    ])),
    T.StructField("dns", T.StructType([T.StructField("rrname", T.StringType())])),
    T.StructField("tls", T.StructType([T.StructField("sni", T.StringType())])),
    T.StructField("http", T.StructType([
        T.StructField("hostname", T.StringType()),
        T.StructField("url", T.StringType()),
    ])),
    T.StructField("fileinfo", T.StructType([
        T.StructField("magic", T.StringType()),
        T.StructField("mime_type", T.StringType()),
    ])),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("tcp_flags_tc", T.StringType()),
])

# Names and order of the flattened, stored event.
STORED_EVENT_COLUMNS = [
    "event_type", "timestamp", "flow_id", "proto", "src_ip", "src_port",
    "dest_ip", "dest_port", "packet_length", "alert_severity", "alert_signature",
    "dns_query", "tls_sni", "http_hostname", "http_url", "file_magic", "file_mime",
    "training_mode", "training_label", "training_session", "anomaly",
]

MODE_LOG = T.StructType([
    T.StructField("effective_from", T.TimestampType()),
    T.StructField("mode", T.StringType()),
    T.StructField("value", T.BooleanType()),
    T.StructField("label", T.StringType()),
    T.StructField("session_hash", T.StringType()),
])

# The feature table's 24 columns in order.
FEATURE_TABLE_COLUMNS = [
    "src_ip", "dest_ip", "proto", "src_port", "dest_port", "alert_severity",
    "packet_length", "hour", "is_night", "ports_used", "conn_per_ip",
    "port_rarity", "ip_rarity", "conn_5m", "port_entropy", "failed_ratio",
    "hour_anomaly", "conn_velocity", "proto_pkt_mean", "proto_pkt_std",
    "proto_ports", "pkt_anomaly", "anomaly", "event_id",
]

# Defaults used when a column is missing (``ensure_columns``).
FEATURE_DEFAULTS = {
    "alert_severity": 0, "packet_length": 0, "hour": 0, "is_night": 0,
    "ports_used": 0, "conn_per_ip": 0, "port_rarity": 0.0, "ip_rarity": 0.0,
    "conn_5m": 0.0, "port_entropy": 0.0, "failed_ratio": 0.0, "hour_anomaly": 0,
    "conn_velocity": 0.0, "proto_pkt_mean": 0.0, "proto_pkt_std": 0.0,
    "proto_ports": 0.0, "pkt_anomaly": 0, "anomaly": -1,
    "proto": 0, "src_port": 0, "dest_port": 0,
    "src_ip": "0.0.0.0", "dest_ip": "0.0.0.0", "event_id": "",
}

# Model inputs: identifiers and the label are never features.
MODEL_FEATURES = [
    "proto", "src_port", "dest_port", "alert_severity", "packet_length", "hour",
    "is_night", "ports_used", "conn_per_ip", "port_rarity", "ip_rarity",
    "conn_5m", "port_entropy", "failed_ratio", "hour_anomaly", "conn_velocity",
    "proto_pkt_mean", "proto_pkt_std", "proto_ports", "pkt_anomaly",
]

# Projection used by the rule generator when it fetches unprocessed events.
SERVING_COLUMNS = [
    "event_id", "src_ip", "dest_ip", "proto", "src_port", "dest_port",
    "alert_severity", "packet_length", "timestamp",
]

ISOLATION_NODE = T.StructType([
    T.StructField("tree_id", T.IntegerType(), False),
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("feature", T.IntegerType(), False),
    T.StructField("threshold", T.DoubleType(), False),
    T.StructField("left", T.IntegerType(), False),
    T.StructField("right", T.IntegerType(), False),
    T.StructField("size", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
])
