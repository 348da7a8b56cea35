"""Ingest: parse sensor lines, flatten, admit, label, hash, de-duplicate.

S1-S3, P1-P3, F11, F12, F18, K1, J8.  Batch and streaming share these
functions; nothing here calls an action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.clock import parse_ts, utc_offset
from netsleuth.functions.hashing import event_hash, fallback_event_id
from netsleuth.schemas import RAW_EVENT
from netsleuth.session import written

# Fields hashed for de-duplication, by their flattened names (Q13 fixed);
# the timestamp is hashed as written.
HASH_FIELDS = ["timestamp_raw" if f == "timestamp" else f for f in K.EVENT_HASH_FIELDS]
# The reference's effective key: its last five parts were always empty.
HASH_FIELDS_COMPAT = HASH_FIELDS[:8]

_BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"


def parse_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Text lines -> ``(e STRUCT, value, _corrupt BOOLEAN)``.

    Malformed lines (not one JSON object: cut off, followed by other text, an
    array, a bare value) are kept with ``_corrupt = true`` so they can be sent
    to a quarantine output instead of being silently dropped.  JSON parsers stop
    at the end of the first value; within brackets anything behind it is an
    error or a second element.
    """
    v = F.col(value_col)
    # one parse for the check and one for the fields: what stands in a filter is not shared with
    # the columns below it, so the check names neither the fields nor the parsed text twice
    listed = F.try_parse_json(F.concat(F.lit("["), v, F.lit("]")))
    alone = F.transform(F.array(listed), lambda x: x.isNotNull() & F.try_variant_get(x, "$[1]", "string").isNull())[0]
    whole = v.rlike(r"^[ \t\r\n]*\{") & alone
    return lines.select(F.from_json(v, RAW_EVENT, {"mode": "PERMISSIVE"}).alias("e"), v.alias("value"), (~F.coalesce(whole, F.lit(False))).alias("_corrupt"))


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("_corrupt").select("value")


def packet_length(packet) -> F.Column:
    """``packet.length`` when the packet is an object, decoded length when it is
    Base64 text, else 0 (Q3)."""
    p = F.col(packet) if isinstance(packet, str) else packet
    obj_len = F.get_json_object(p, "$.length").try_cast("int")
    b64 = F.when(~p.startswith("{") & p.rlike(_BASE64),
                 F.octet_length(F.try_to_binary(p, F.lit("base64"))))
    return F.coalesce(obj_len, b64, F.lit(0))


def flatten(parsed: DataFrame) -> DataFrame:
    """Parsed struct -> flat stored record with the reference defaults."""
    e = lambda name: F.col(f"e.{name}")
    ts_raw = F.coalesce(e("timestamp"), F.lit(K.MISSING_TIMESTAMP))
    return parsed.where(~F.col("_corrupt")).select(
        e("event_type").alias("event_type"),
        ts_raw.alias("timestamp_raw"),
        parse_ts(ts_raw).alias("timestamp"),
        utc_offset(ts_raw).alias("utc_offset"),
        e("flow_id").alias("flow_id"),
        F.upper(F.coalesce(e("proto"), F.lit(K.DEFAULT_PROTO))).alias("proto"),
        F.coalesce(e("src_ip"), F.lit(K.DEFAULT_IP)).alias("src_ip"),
        F.coalesce(e("src_port"), F.lit(0)).alias("src_port"),
        F.coalesce(e("dest_ip"), F.lit(K.DEFAULT_IP)).alias("dest_ip"),
        F.coalesce(e("dest_port"), F.lit(0)).alias("dest_port"),
        packet_length(e("packet")).alias("packet_length"),
        F.coalesce(e("alert.severity"), F.lit(0)).alias("alert_severity"),
        F.coalesce(e("alert.signature"), F.lit(K.MISSING_SIGNATURE)).alias("alert_signature"),
        e("dns.rrname").alias("dns_query"),
        e("tls.sni").alias("tls_sni"),
        e("http.hostname").alias("http_hostname"),
        e("http.url").alias("http_url"),
        e("fileinfo.magic").alias("file_magic"),
        e("fileinfo.mime_type").alias("file_mime"),
        e("tcp_flags").alias("tcp_flags"),
        e("tcp_flags_tc").alias("tcp_flags_tc"),
    )


def admit(df: DataFrame, training_col: str = "training_mode") -> DataFrame:
    """Mode-dependent admission (P1): training keeps all but ``stats``,
    otherwise only ``alert``.  NULL event types count as 'not stats'."""
    et = F.col("event_type")
    training = F.coalesce(F.col(training_col), F.lit(False))
    return df.where((training & ~F.coalesce(et == "stats", F.lit(False)))
                    | (~training & F.coalesce(et == "alert", F.lit(False))))


def label(df: DataFrame, mode_col: str = "mode", session_col: str = "session") -> DataFrame:
    """Label projection (P3) from a normalised mode column."""
    mode = F.coalesce(F.col(mode_col), F.lit(K.MODE_OFF))
    training = mode.isin(K.MODE_NORMAL, K.MODE_ANOMALY)
    return (df.withColumn("training_mode", training)
              .withColumn("training_label", F.when(training, mode).otherwise(F.lit(K.LABEL_UNKNOWN)))
              .withColumn("training_session", F.when(training, F.col(session_col)))
              .withColumn("anomaly", F.when(mode == K.LABEL_ANOMALY, 1).otherwise(0)))


def with_event_hash(df: DataFrame, compat: bool = False) -> DataFrame:
    return df.withColumn("event_hash", event_hash(HASH_FIELDS_COMPAT if compat else HASH_FIELDS))


def with_fallback_id(df: DataFrame, ts_col: str = "timestamp_raw") -> DataFrame:
    return df.withColumn("event_id", fallback_event_id("src_ip", "dest_ip", ts_col))


def with_event_id(df: DataFrame) -> DataFrame:
    """The id of a stored event: its hash, which is unique in the store.
    (``with_fallback_id`` serves tables that carry neither.)"""
    return df.withColumn("event_id", F.col("event_hash")) if "event_id" not in df.columns else df


def with_event_date(df: DataFrame) -> DataFrame:
    """Partition column of the stored table: the event's UTC date."""
    return df.withColumn("event_date", F.to_date("timestamp"))


# Rows of a batch up to which its hashes are broadcast to the stored side.
BROADCAST_HASHES = 500_000


def dedup_new(batch: DataFrame, stored_keys: DataFrame | None, broadcast_rows: int = BROADCAST_HASHES) -> DataFrame:
    """Insert-if-new (K1, J8): one row per ``event_hash``, minus stored hashes.

    The batch is grouped by partial aggregation, so one hot hash does not gather
    in one task.  The stored side is not shuffled while the batch has at most
    ``broadcast_rows`` hashes: they are broadcast to the scan of the stored
    ``(event_date, event_hash)``, and the few that are found there come back.
    Larger batches meet the stored keys in a shuffled anti-join.
    """
    if "event_date" not in batch.columns:
        batch = with_event_date(batch)
    others = [c for c in batch.columns if c != "event_hash"]
    # deterministic survivor among rows sharing a hash: min of the remaining fields
    fresh = (batch.groupBy("event_hash").agg(F.min(F.struct(*others)).alias("_r"))
                  .select("event_hash", *[F.col(f"_r.{c}").alias(c) for c in others]))
    if stored_keys is None:
        return fresh
    keys = stored_keys.select(F.col("event_date").alias("_d"), F.col("event_hash").alias("_h"))
    same = lambda e, h, d: (e[h] == keys["_h"]) & e[d].eqNullSafe(keys["_d"])
    wanted = batch.select(F.col("event_hash").alias("_w"), F.col("event_date").alias("_wd"))
    if wanted.count() <= broadcast_rows:
        keys = keys.join(F.broadcast(wanted), same(wanted, "_w", "_wd"), "left_semi")
    return fresh.join(keys, same(fresh, "event_hash", "event_date"), "left_anti")


def ingest(lines: DataFrame, modes: DataFrame | None = None, stored_keys: DataFrame | None = None,
           compat_hash: bool = False, training: bool | None = None) -> DataFrame:
    """Lines -> new stored events: parse, flatten, mode lookup, admit, label,
    hash, de-duplicate (the whole live-ingest path as one plan)."""
    return ingest_flat(flatten(parse_lines(lines)), modes, stored_keys, compat_hash, training)


def ingest_flat(flat: DataFrame, modes: DataFrame | None = None, stored_keys: DataFrame | None = None,
                compat_hash: bool = False, training: bool | None = None) -> DataFrame:
    """``ingest`` from rows that ``flatten`` has made already."""
    from netsleuth.operators.modes import attach_mode  # local import: avoid cycle

    if modes is not None:
        flat = attach_mode(flat, modes)
    else:
        const = K.MODE_NORMAL if training else K.MODE_OFF
        flat = flat.withColumn("mode", F.lit(const)).withColumn("session", F.lit(None).cast("string"))
    labelled = label(flat)
    admitted = admit(labelled)
    hashed = with_event_id(with_event_hash(admitted, compat=compat_hash))
    if stored_keys is not None:
        hashed = written(hashed, "ingest-batch")      # counted, grouped and looked up, parsed once
    return dedup_new(hashed, stored_keys)
