import hashlib
import ipaddress

import pytest
from pyspark.sql import functions as F

from netsleuth.functions.clock import parse_ts, wall_clock_hour, is_night, utc_offset
from netsleuth.functions.hashing import event_hash, fallback_event_id, sha_mod
from netsleuth.functions.ip import canonical_ip, ip_to_int, ipv4_to_int, ipv6_halves
from netsleuth.functions.ruletext import fmt2, header, sid_of
from netsleuth.functions.scalar import coerce_numeric, normalise_mode

IPS = ["10.0.0.1", "256.1.1.1", "01.2.3.4", "0.0.0.0", "255.255.255.255", "1.2.3", "fe80::1",
       "2001:db8:0:0:1:0:0:1", "::", "::1", "1::", "2001:0DB8::0001", "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7:8",
       "1::2::3", "12345::", "fe80::1%eth0", "", "garbage", None]


def _py(ip):
    try:
        a = ipaddress.ip_address(ip)
        return str(a), int(a)
    except Exception:
        return None, 0


def test_ip_functions_match_python(spark):
    df = spark.createDataFrame([(v,) for v in IPS], "ip string")
    rows = df.select("ip", canonical_ip("ip").alias("c"), ip_to_int("ip").alias("n"),
                     ipv6_halves("ip").alias("h"), ipv4_to_int("ip").alias("v4")).collect()
    for r in rows:
        canon, num = _py(r.ip)
        assert r.c == canon, r.ip
        assert r.n == pytest.approx(float(num)), r.ip
        if r.h is not None:
            assert int(r.h.hi) * 2 ** 64 + int(r.h.lo) == num
        if canon and "%" in canon:
            canon = canon.split("%")[0]
        if canon is not None and ":" not in canon:
            assert r.v4 == num
    fixture = dict((r.ip, r.v4) for r in rows)
    assert fixture["10.0.0.1"] == 167772161 and fixture["256.1.1.1"] == 0 and fixture["01.2.3.4"] == 0


def test_wall_clock_hour_and_night(spark):
    raws = ["2025-05-12T10:00:00.123456+0200", "2025-05-12T10:00:00.123456+0100", "2025-05-12T10:00:01+0200",
            "Desconocido", "2025-05-12T08:00:01.000000Z", "2025-05-12T23:59:59+02:00"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    out = df.select(wall_clock_hour("raw").alias("h"), parse_ts("raw").alias("t"), utc_offset("raw").alias("o")).collect()
    assert [r.h for r in out] == [10, 10, 10, 0, 8, 23]
    assert out[3].t is None and out[3].o is None
    assert out[0].o == "+0200" and out[4].o == "Z"
    hours = spark.createDataFrame([(6,), (7,), (20,), (21,), (None,)], "h int")
    got = [r[0] for r in hours.select(is_night(F.coalesce("h", F.lit(0)))).collect()]
    assert got == [1, 0, 0, 1, 1]


def test_sha_mod_fixtures(spark):
    texts = ["192.168.1.5", "10.0.0.1-443-tcp", "x", "ML-rule-with-a-longer-text-0.123"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sha_mod("t", 900_000)).collect()]
    want = [int(hashlib.sha256(t.encode()).hexdigest(), 16) % 900_000 for t in texts]
    assert got == want
    assert got[0] == 386628 and got[1] == 630240
    got2 = [r[0] for r in df.select(sha_mod("t", 500_000, 3_000_000)).collect()]
    assert got2 == [3_000_000 + int(hashlib.sha256(t.encode()).hexdigest(), 16) % 500_000 for t in texts]


def test_event_hash_and_fallback_id(spark):
    row = ("alert", "2025-05-12T10:00:00+0200", None, 5)
    df = spark.createDataFrame([row], "a string, b string, c string, d int")
    h, fid = df.select(event_hash(["a", "b", "c", "d"]), fallback_event_id("a", "b", "c")).first()
    assert h == hashlib.sha256("alert|2025-05-12T10:00:00+0200|None|5".encode()).hexdigest()
    assert fid == hashlib.md5("alert-2025-05-12T10:00:00+0200-None".encode()).hexdigest()


def test_normalise_mode_and_coerce(spark):
    rows = [(" Normal", None, None), ("OFF", True, "anomaly"), (None, True, "Anomaly"), (None, True, "foo"),
            ("weird", False, "normal"), (None, None, None)]
    df = spark.createDataFrame(rows, "mode string, value boolean, label string")
    got = [r[0] for r in df.select(normalise_mode("mode", "value", "label")).collect()]
    assert got == ["normal", "off", "anomaly", "off", "off", "off"]
    vals = spark.createDataFrame([("1.5",), ("TCP",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in vals.select(coerce_numeric("v")).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_rule_text_helpers(spark):
    df = spark.createDataFrame([(-0.125,), (0.125,), (-0.001,), (0.145,)], "x double")
    assert [r[0] for r in df.select(fmt2("x")).collect()] == ["-0.13", "0.13", "-0.00", "0.15"]
    t = spark.createDataFrame([("#alert tcp 1.2.3.4 any -> 5.6.7.8 22 (msg:\"a\"; sid:3000001; rev:1;)",)], "t string")
    hdr, sid = t.select(header("t"), sid_of("t")).first()
    assert hdr == "#alert tcp 1.2.3.4 any -> 5.6.7.8 22" and sid == 3000001
