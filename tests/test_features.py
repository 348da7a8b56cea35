import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsleuth.operators import features as FT
from netsleuth.operators import sequence


def _ts(s):
    return dt.datetime.fromisoformat(s) if s else None


def test_trailing_five_minutes(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 00:05:00", "2024-01-01 00:09:59.999999", None]
    df = spark.createDataFrame([(str(i), "s", _ts(t)) for i, t in enumerate(times)], "event_id string, src_ip string, timestamp timestamp")
    got = {r.event_id: r.conn_5m for r in FT.conn_5m(df).collect()}
    assert [got[str(i)] for i in range(5)] == [1, 2, 2, 3, 0]


def test_inter_arrival_mean(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:10", "2024-01-01 00:00:15"]
    df = spark.createDataFrame([(str(i), "s", _ts(t)) for i, t in enumerate(times)] + [("9", "s", None)],
                               "event_id string, src_ip string, timestamp timestamp")
    got = {r.event_id: r.conn_velocity for r in FT.conn_velocity(df).collect()}
    assert [got["0"], got["1"], got["2"], got["9"]] == [0.0, 10.0, 7.5, 0.0]


def _random_sequence(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    src = rng.choice(["hot"] * 8 + ["a", "b"], size=n)      # one source holds most rows
    t0 = pd.Timestamp("2024-01-01")
    secs = np.sort(rng.integers(0, 6 * 3600, size=n))
    ts = [t0 + pd.Timedelta(seconds=int(s)) for s in secs]
    flags = rng.choice(["S", "A"], size=n)
    return pd.DataFrame({"event_id": [f"{i:05d}" for i in range(n)], "src_ip": src, "timestamp": ts,
                         "tcp_flags_tc": flags})


def test_ordered_features_match_pandas_under_skew(spark):
    pdf = _random_sequence()
    df = spark.createDataFrame(pdf)
    vel = FT.conn_velocity(df).toPandas().set_index("event_id")["conn_velocity"]
    roll = FT.failed_ratio_rolling(df).toPandas().set_index("event_id")["failed_ratio_rolling"]
    c5 = FT.conn_5m(df).toPandas().set_index("event_id")["conn_5m"]
    # written as loops over each source's sorted rows
    for _, rows in pdf.groupby("src_ip"):
        rows = sorted(zip(rows["timestamp"], rows["event_id"], rows["tcp_flags_tc"]))
        for i, (t, eid, _) in enumerate(rows):
            steps = [(rows[j][0] - rows[j - 1][0]).total_seconds() for j in range(max(1, i - 4), i + 1)]
            assert vel[eid] == pytest.approx(sum(steps) / len(steps) if steps else 0.0, abs=1e-9)
            last = [f == "S" for _, _, f in rows[max(0, i - 19):i + 1]]
            assert roll[eid] == pytest.approx(sum(last) / len(last))
            assert c5[eid] == sum(0 <= (t - u).total_seconds() < 300 or u == t for u, _, _ in rows[max(0, i - 300):i + 300] if u <= t)
    got = FT.ordered_features(df, flag_col="tcp_flags_tc").toPandas().set_index("event_id")
    for eid in pdf["event_id"]:
        assert got.conn_5m[eid] == c5[eid] and got.conn_velocity[eid] == pytest.approx(vel[eid], abs=1e-9)
        assert got.failed_ratio_rolling[eid] == pytest.approx(roll[eid])


def test_rows_without_source_or_time_stay(spark):
    rows = [("1", None, _ts("2024-01-01 00:00:00")), ("2", None, _ts("2024-01-01 00:00:10")), ("3", "a", _ts("2024-01-01 00:00:00")),
            ("4", "a", _ts("2024-01-01 00:00:10")), ("5", "a", None), ("6", None, None)]
    df = spark.createDataFrame([(*r, "S", "10.0.0.1", 0, 0, 7) for r in rows],
                               "event_id string, src_ip string, timestamp timestamp, tcp_flags_tc string, dest_ip string, "
                               "alert_severity int, packet_length int, dest_port int").withColumn("proto", F.lit("TCP"))
    for f, col in ((FT.conn_velocity, "conn_velocity"), (FT.conn_5m, "conn_5m"), (FT.failed_ratio_rolling, "failed_ratio_rolling")):
        got = {r.event_id: r[col] for r in f(df).collect()}
        assert len(got) == 6 and got["1"] == got["2"] == got["6"] == 0, col
    ft = {r.event_id: r for r in FT.features(df).collect()}
    assert len(ft) == 6 and ft["1"].ports_used == 0 and ft["1"].conn_5m == 0
    assert (ft["4"].conn_5m, ft["4"].conn_velocity, ft["5"].conn_5m) == (2, 10.0, 0)
    flags = {r.event_id: r.failed_ratio for r in FT.features(df, failed_by_flags=True).collect()}
    assert flags["4"] == 1.0 and flags["1"] == 0.0
    assert {r.proto for r in FT.features(df, codes={"UDP": 0}).collect()} == {-1}


def test_positions_are_dense_per_key(spark):
    pdf = _random_sequence(2000, seed=3)
    d = sequence.positions(spark.createDataFrame(pdf), "src_ip", "timestamp", "event_id",
                           chunk_micros=600 * 1_000_000).toPandas()
    for _, grp in d.groupby("src_ip"):
        grp = grp.sort_values(["timestamp", "event_id"])
        assert list(grp["_pos"]) == list(range(len(grp)))


def test_entropy_modal_hour_and_codes(spark):
    rows = [("a", 22, 3), ("a", 22, 5), ("a", 80, 3), ("a", 80, 5), ("a", None, 23),
            ("b", 22, 1), ("c", None, 2)]
    df = spark.createDataFrame([(f"e{i}", s, p, h, "10.0.0.1", 0) for i, (s, p, h) in enumerate(rows)],
                               "event_id string, src_ip string, dest_port int, hour int, dest_ip string, alert_severity int")
    st = {r.src_ip: r for r in FT.source_stats(df).collect()}
    assert st["a"].port_entropy == pytest.approx(math.log(2), abs=1e-9)
    assert abs(st["b"].port_entropy) < 1e-9 and st["c"].port_entropy == 0.0
    assert st["a"].modal_hour == 3 and st["a"].ports_used == 2 and st["a"].conn_per_ip == 5
    flags = [r.hour_anomaly for r in FT.add_source_features(df).where("src_ip = 'a'").orderBy("event_id").collect()]
    assert flags == [0, 0, 0, 0, 1]
    protos = spark.createDataFrame([("UDP",), ("TCP",), (None,), ("ICMP",)], "proto string")
    codes = [r.proto_code for r in FT.proto_codes(protos).collect()]
    assert sorted(codes) == [-1, 0, 1, 2]
    m = {r.proto: r.proto_code for r in FT.proto_codes(protos).collect()}
    assert m == {"UDP": 2, "TCP": 1, None: -1, "ICMP": 0}


def test_single_row_protocol_has_no_deviation(spark):
    df = spark.createDataFrame([("ICMP", 60, 1), ("TCP", 10, 2), ("TCP", 20, 3)],
                               "proto string, packet_length int, dest_port int")
    out = {r.proto + str(r.packet_length): r for r in FT.add_proto_features(df).collect()}
    assert out["ICMP60"].proto_pkt_std is None and out["ICMP60"].pkt_anomaly == 0


def test_feature_table_columns(spark):
    from netsleuth.schemas import FEATURE_TABLE_COLUMNS
    from netsleuth.sources.flowview import flows
    ft = FT.features(flows(spark, "/root/testdata/sf0.001"))
    assert ft.columns[:24] == FEATURE_TABLE_COLUMNS
    assert ft.count() == 1000


def test_hour_options(spark):
    from netsleuth.functions.scalar import hour_anomaly_flag
    df = spark.createDataFrame([(23, 0), (1, 22), (5, 1)], "hour int, modal int")
    assert [r[0] for r in df.select(hour_anomaly_flag("hour", "modal")).collect()] == [1, 1, 1]
    assert [r[0] for r in df.select(hour_anomaly_flag("hour", "modal", circular=True)).collect()] == [0, 0, 1]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 22, 30),)], "timestamp timestamp")
    assert FT.with_hour(ts, tz="Europe/Madrid").first().hour == 23


def test_range_chunks_split_a_hot_key(spark):
    pdf = _random_sequence(3000, seed=5)
    df = spark.createDataFrame(pdf)
    ranged = df.repartitionByRange(13, "src_ip", "timestamp", "event_id").withColumn("_p", F.spark_partition_id())
    assert ranged.where("src_ip = 'hot'").select("_p").distinct().count() > 5     # the hot key is split
    a = sequence.positions(df, "src_ip", "timestamp", "event_id", parts=13)
    b = sequence.positions(df, "src_ip", "timestamp", "event_id", method="time")
    assert {r.event_id: r._pos for r in a.collect()} == {r.event_id: r._pos for r in b.collect()}


def test_trailing_count_range_method_matches_bucket(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 00:05:00", "2024-01-01 00:09:59.999999", None]
    fx = spark.createDataFrame([(str(i), "s", _ts(t)) for i, t in enumerate(times)],
                               "event_id string, src_ip string, timestamp timestamp")
    got = {r.event_id: r.c for r in sequence.trailing_count(fx, "src_ip", "timestamp", 300_000_000, "c",
                                                             method="range", id_col="event_id").collect()}
    assert [got[str(i)] for i in range(5)] == [1, 2, 2, 3, 0]
    df = spark.createDataFrame(_random_sequence(2500, seed=9))
    a = sequence.trailing_count(df, "src_ip", "timestamp", 300_000_000, "c", method="range", id_col="event_id")
    b = sequence.trailing_count(df, "src_ip", "timestamp", 300_000_000, "c")
    assert {r.event_id: r.c for r in a.collect()} == {r.event_id: r.c for r in b.collect()}
