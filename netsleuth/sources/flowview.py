"""Stand-in inputs derived from the driver's ``events`` table.

The reference reads network-sensor events.  The test tables hold generic
``events(event_id, ts, user_id, event_type, value, props)``; these functions
only *reshape* them into the schemas the operators expect (flow records, raw
JSON lines, a mode log, a score column).  They do none of the operators'
work, and the operators never rely on how these rows were formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth.session import prepare, scratch_path, spread, written


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flow_view(events: DataFrame) -> DataFrame:
    """Driver ``events`` -> stored-event-like flow records (FIXTURES §2)."""
    et = F.col("et")
    eid = F.col("event_id")
    b = events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("et"), "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return b.select(
        eid.cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        eid.alias("flow_id"),
        F.when(et.isin("error", "purchase"), "alert").when(et == "signup", "dns")
         .when(et == "click", "http").otherwise("flow").alias("event_type"),
        F.when(et == "error", "TCP").when(et == "purchase", "UDP").when(et == "signup", "ICMP")
         .when(et == "click", "TCP").otherwise("UDP").alias("proto"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 16).cast("string"), F.lit("."),
                 (F.col("user_id") % 251).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.10."),
                 (F.floor("value").cast("int") % 40).cast("string")).alias("dest_ip"),
        F.when(eid % 11 == 0, 0).otherwise(F.lit(1024) + eid % 50000).cast("int").alias("src_port"),
        F.when(F.col("k") == 99, 443).when(F.col("k") == 98, 123).otherwise(F.col("k"))
         .cast("int").alias("dest_port"),
        F.floor("value").cast("int").alias("packet_length"),
        F.when(et == "error", F.lit(1) + eid % 3).otherwise(0).cast("int").alias("alert_severity"),
        F.when(eid % 2 == 0, "S").otherwise("A").alias("tcp_flags_tc"),
        F.lit(True).alias("training_mode"),
        F.when((F.col("value") > 150) | (eid % 37 == 0), "anomaly").otherwise("normal").alias("training_label"),
        F.when(eid % 5 < 3, "session-a").otherwise("session-b").alias("training_session"),
        (F.round(F.lit(0.15) - F.col("value") / 1000, 6) + (eid % 7) * F.lit(0.01)).alias("anomaly_score"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_view(load_table(spark, sf_dir, "events"))


def with_model_prediction(scored: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """Isolation-forest convention: decision < 0 -> -1 (anomaly), else 1."""
    return scored.withColumn("prediction", F.when(F.col(score_col) < 0, -1).otherwise(1))


def raw_lines(events: DataFrame) -> DataFrame:
    """Driver ``events`` -> sensor-style JSON lines ``(value STRING)``.

    Shapes covered: lower/upper-case protocol, ICMP without ports, +0000 and
    +0200 offsets (same instant), packets as object or Base64 text, nested
    alert/dns/http/tls/fileinfo blocks, ``stats`` lines, a missing timestamp,
    and exact duplicate lines.
    """
    fv = flow_view(events).withColumn("eid", F.col("flow_id"))
    eid = F.col("eid")
    shifted = (eid % 3 == 0)
    ts = F.col("timestamp")
    ts_text = (F.when(eid % 97 == 5, F.lit(None))
               .when(shifted, F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"),
                                                     "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0200")))
               .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0000"))))
    icmp = F.col("proto") == "ICMP"
    event_type = F.when(eid % 23 == 7, "stats").otherwise(F.col("event_type"))
    proto = F.when(eid % 4 == 1, F.lower("proto")).otherwise(F.col("proto"))
    # the packet is a JSON object for even ids and Base64 text for odd ids
    ns = lambda *kv: F.named_struct(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    fields = ns(
        "event_type", event_type,
        "timestamp", ts_text,
        "flow_id", F.col("flow_id"),
        "proto", proto,
        "src_ip", F.col("src_ip"),
        "src_port", F.when(~icmp, F.col("src_port")),
        "dest_ip", F.col("dest_ip"),
        "dest_port", F.when(~icmp, F.col("dest_port")),
        "alert", F.when(F.col("event_type") == "alert",
                        ns("severity", F.col("alert_severity"),
                           "signature", F.when(eid % 5 != 0, F.concat(F.lit("sig-"), (eid % 13).cast("string"))))),
        "dns", F.when(F.col("event_type") == "dns",
                      ns("rrname", F.concat(F.lit("host"), (eid % 17).cast("string"), F.lit(".example")))),
        "http", F.when(F.col("event_type") == "http",
                       ns("hostname", F.concat(F.lit("web"), (eid % 7).cast("string"), F.lit(".example")),
                          "url", F.concat(F.lit("/p/"), (eid % 29).cast("string")))),
        "tls", F.when((F.col("event_type") == "flow") & (eid % 2 == 1),
                      ns("sni", F.concat(F.lit("tls"), (eid % 5).cast("string"), F.lit(".example")))),
        "tcp_flags_tc", F.col("tcp_flags_tc"),
    )
    body = F.to_json(fields)
    line = F.concat(F.expr("substring(_body, 1, length(_body) - 1)"), F.lit(',"packet":'), F.col("_packet"), F.lit("}"))
    copies = F.when(eid % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    staged = fv.select(F.explode(copies).alias("copy"), body.alias("_body"), F.col("packet_length"), eid)
    pj = F.when(eid % 2 == 0, F.to_json(F.struct(F.col("packet_length").alias("length")))) \
          .otherwise(F.concat(F.lit('"'), F.regexp_replace(F.base64(F.repeat(F.lit("x"), F.col("packet_length"))), r"\s", ""),
                             F.lit('"')))
    return staged.withColumn("_packet", pj).select(line.alias("value")).unionByName(broken_lines(events))


def broken_lines(events: DataFrame) -> DataFrame:
    """Malformed lines among the stand-in log: cut off, followed by other text,
    an array, two objects, a bare value, empty braces with a tail."""
    eid = F.col("event_id").cast("string")
    start = F.concat(F.lit('{"event_type":"alert","flow_id":'), eid)
    text = (F.when(F.col("event_id") % 41 == 1, F.concat(start, F.lit(',"timest')))
            .when(F.col("event_id") % 41 == 2, F.concat(start, F.lit("}trailing")))
            .when(F.col("event_id") % 41 == 3, F.concat(F.lit("["), start, F.lit("}]")))
            .when(F.col("event_id") % 41 == 4, F.concat(start, F.lit("} "), start, F.lit("}")))
            .when(F.col("event_id") % 41 == 5, eid)
            .when(F.col("event_id") % 41 == 6, F.concat(start, F.lit("}}"))))
    return events.select(text.alias("value")).where(F.col("value").isNotNull())


def mode_log(events: DataFrame) -> DataFrame:
    """Mode switches: one row per driver event with ``k`` in {0, 1}.

    Both document shapes appear: the current ``mode`` text (sometimes padded or
    upper-case) and the legacy ``value``/``label`` pair; some rows carry a
    session id, the others get one derived from their time (F10).
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = events.where(k.isin(0, 1)).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    eid = F.col("event_id")
    mode = (F.when(eid % 5 == 0, F.lit(" Normal"))
            .when(eid % 5 == 1, F.lit("anomaly"))
            .when(eid % 5 == 2, F.lit("OFF")))
    value = F.when(eid % 5 == 3, F.lit(True)).when(eid % 5 == 4, F.lit(False))
    label = F.when(F.col("user_id") % 2 == 0, F.lit("Anomaly")).otherwise(F.lit("normal"))
    session = F.when(eid % 3 == 0, F.substring(F.sha2(eid.cast("string"), 256), 1, 16))
    return e.select(F.col("ts").alias("effective_from"), mode.alias("mode"), value.alias("value"),
                    label.alias("label"), session.alias("session_hash"))


_LINE_FILES: dict[tuple, str] = {}


def raw_line_files(spark: SparkSession, sf_dir: str, parts: int = 8) -> str:
    """Write the stand-in sensor lines of ``sf_dir`` once per session as text
    files below the shared checkpoint folder; return the folder.

    The events are spread first: a small file of many rows is read by few tasks,
    and making a line costs far more than moving its event."""
    key = (id(spark), sf_dir)
    path = _LINE_FILES.get(key)
    if path is None:
        path = scratch_path(spark, "sensor-lines")
        raw_lines(spread(load_table(spark, sf_dir, "events"))).repartition(parts).write.text(path)
        _LINE_FILES[key] = path
    return path


def mode_log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in mode log of ``sf_dir``, stored: a look-up reads the log
    several times, a stream does so in each of its micro-batches."""
    return written(mode_log(load_table(spark, sf_dir, "events")), "mode-log")


def lines_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in sensor log, read back as a text source (S1/S2 path)."""
    from netsleuth.sources.events import read_lines
    return read_lines(spark, raw_line_files(spark, sf_dir))
