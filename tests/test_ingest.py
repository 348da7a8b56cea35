import datetime as dt

import pytest
from pyspark.sql import functions as F

from netsleuth.operators import ingest as IG
from netsleuth.operators.modes import attach_mode

LINES = [
    '{"event_type":"alert","timestamp":"2025-05-12T10:00:00.123456+0200","flow_id":1,"proto":"tcp","src_ip":"10.0.0.5","src_port":50000,"dest_ip":"192.168.10.20","dest_port":22,"packet":"AAAA","alert":{"severity":2,"signature":"a"}}',
    '{"event_type":"alert","timestamp":"2025-05-12T10:00:00.123456+0200","flow_id":1,"proto":"tcp","src_ip":"10.0.0.5","src_port":50000,"dest_ip":"192.168.10.20","dest_port":22,"packet":"AAAA","alert":{"severity":2,"signature":"b"}}',
    '{"event_type":"dns","timestamp":"2025-05-12T08:00:01.000000Z","flow_id":2,"proto":"UDP","src_ip":"fe80::1","dest_ip":"10.0.2.3","dest_port":53,"dns":{"rrname":"example.org"}}',
    '{"event_type":"stats","timestamp":"2025-05-12T08:00:02.000000Z"}',
    '{"event_type":"alert","src_ip":"999.1.1.1","dest_ip":"192.168.10.20","packet":{"length":60}}',
    'not json',
]


def _lines(spark):
    return spark.createDataFrame([(v,) for v in LINES], "value string")


def test_flatten_and_quarantine(spark):
    parsed = IG.parse_lines(_lines(spark))
    assert IG.quarantine(parsed).count() == 1
    flat = IG.flatten(parsed).collect()
    assert len(flat) == 5
    first = flat[0]
    assert first.proto == "TCP" and first.packet_length == 3 and first.alert_signature == "a"
    last = [r for r in flat if r.src_ip == "999.1.1.1"][0]
    assert last.timestamp is None and last.timestamp_raw == "Desconocido" and last.packet_length == 60
    assert last.alert_signature == "Sin firma" and last.dest_port == 0


def test_admission_by_mode(spark):
    flat = IG.flatten(IG.parse_lines(_lines(spark)))
    training = IG.admit(IG.label(flat.withColumn("mode", F.lit("normal")).withColumn("session", F.lit("s1"))))
    normal = IG.admit(IG.label(flat.withColumn("mode", F.lit("off")).withColumn("session", F.lit(None).cast("string"))))
    assert training.count() == 4 and normal.count() == 3


def test_hash_corrected_and_compat(spark):
    flat = IG.flatten(IG.parse_lines(_lines(spark))).limit(2)
    assert IG.with_event_hash(flat).select("event_hash").distinct().count() == 2
    assert IG.with_event_hash(flat, compat=True).select("event_hash").distinct().count() == 1


def test_hour_and_ip_of_fixture(spark):
    from netsleuth.operators.features import with_hour
    from netsleuth.functions.ip import ip_to_int
    flat = IG.flatten(IG.parse_lines(_lines(spark)))
    out = with_hour(flat, raw_col="timestamp_raw").select("flow_id", "src_ip", "hour", "is_night",
                                                           ip_to_int("src_ip").alias("n")).collect()
    by_src = {r.src_ip: r for r in out}
    assert by_src["10.0.0.5"].hour == 10
    assert by_src["999.1.1.1"].hour == 0 and by_src["999.1.1.1"].is_night == 1 and by_src["999.1.1.1"].n == 0.0


def test_mode_asof_matches_a_loop_with_ties(spark):
    """Ties, flood minutes, gaps of days, events before the first row and
    without time; the same with broadcast and with shuffled look-up tables."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    log = [(at(100), "normal", "a"), (at(100), "off", None), (at(100), "anomaly", "b"), (at(130), "off", None), (at(130), "anomaly", "c"),
           (at(86400 * 3 + 5), "off", None), (at(86400 * 3 + 65), "normal", "d"), (None, "anomaly", "x")]
    modes = spark.createDataFrame(log, "effective_from timestamp, mode string, session_hash string")
    times = [None, 0, 99, 100, 101, 129, 130, 200, 86399, 86400, 86400 * 3, 86400 * 3 + 5, 86400 * 3 + 64, 86400 * 3 + 65, 86400 * 9] + [120] * 40
    rows = [(i, None if s is None else at(s)) for i, s in enumerate(times)] + [(99, at(120)), (99, at(120))]
    ev = spark.createDataFrame(rows, "i long, timestamp timestamp")

    def want(t):
        rows = [(f, m, s if m != "off" else None) for f, m, s in log if f is not None and t is not None and f <= t]
        return max(rows, key=lambda r: (r[0], r[1], r[2] or ""))[1:] if rows else ("off", None)
    for limit in (0, 1000):
        got = sorted((r.i, r.mode, r.session) for r in attach_mode(ev, modes, broadcast_switches=limit).collect())
        assert [(i, m, s) for i, m, s in got] == sorted((i, *want(t)) for i, t in rows)
    assert attach_mode(ev, modes.limit(0)).where("mode = 'off'").count() == len(rows)


def test_malformed_lines_go_to_quarantine(spark):
    bad = ['{"event_type":"alert","timest', "{}trailing", '[{"event_type":"alert"}]', '{"a":1} {"b":2}', '{"a":1},{"b":2}', '{"a":1}}', "null", '"x"', "7", "", " "]
    good = ["{}", ' {"event_type":"alert"} ', '{"event_type":"alert","flow_id":"x","more":[1,{"y":2}]}', '{"s":"} {"}']
    parsed = IG.parse_lines(spark.createDataFrame([(v,) for v in bad + good], "value string"))
    assert sorted(r.value for r in IG.quarantine(parsed).collect()) == sorted(bad)
    assert IG.flatten(parsed).count() == len(good)


def test_ingested_events_feed_the_features(spark):
    from netsleuth.operators import explore as EX
    from netsleuth.operators import features as FT
    stored = IG.ingest(_lines(spark), training=True)
    assert stored.select("event_id").distinct().count() == stored.count() == 4
    ft = {r.event_id: r for r in FT.features(stored).collect()}
    first = stored.where("flow_id = 1").first()
    assert ft[first.event_id].hour == 10 and ft[first.event_id].failed_ratio == 1.0     # as written; by severity
    ledger = EX.mark_processed(stored.limit(1))
    assert EX.unprocessed(stored, ledger).count() == 3 and EX.unprocessed(stored, ledger, 2).count() == 2
    none = FT.features(stored.drop("event_id"))                                          # fallback ids, two events share one
    assert none.count() == 4


def test_dedup_against_store_is_null_safe(spark):
    flat = IG.flatten(IG.parse_lines(_lines(spark)))
    lab = IG.label(flat.withColumn("mode", F.lit("normal")).withColumn("session", F.lit("s")))
    hashed = IG.with_event_date(IG.with_event_hash(IG.admit(lab)))
    first = IG.dedup_new(hashed, None)
    again = IG.dedup_new(hashed.unionByName(hashed), first.select("event_date", "event_hash"))
    assert first.count() == 4 and again.count() == 0
