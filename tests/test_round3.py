"""Mode steps, cursor paging, broadcast de-duplication, growing files, misses."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from netsleuth.operators import evaluate as EV
from netsleuth.operators import explore as EX
from netsleuth.operators import ingest as IG
from netsleuth.operators import sequence
from netsleuth.operators.modes import attach_mode, mode_steps
from netsleuth.sources import artifacts as A
from netsleuth.sources import growing


def _time(us):
    return dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_mode_steps_against_a_sorted_search(spark, limit):
    """Switches and events within one microsecond, second, minute, hour and days apart; ties; both kinds of join."""
    rng = random.Random(limit)
    near = [0, 1, 5, 999_999, 1_000_000, 1_000_001, 59_999_999, 60_000_000, 60_000_500, 3_600_000_000, 90_000_000_000, 7 * 86_400_000_000]
    at = [rng.choice(near) + rng.choice([0, 1, 2, 500_000, 30_000_000]) for _ in range(60)]
    log = [(_time(t), rng.choice(["normal", "anomaly", "off"]), None, None, f"s{rng.randint(0, 3)}") for t in at]
    log += [(_time(at[0]), "normal", None, None, "tie"), (None, "normal", None, None, "never")]
    times = [x + d for x in at for d in (-1, 0, 1)] + [rng.randrange(8 * 86_400_000_000) for _ in range(200)] + [-5, 30 * 86_400_000_000]
    ev = spark.createDataFrame([(i, _time(t)) for i, t in enumerate(times)] + [(-1, None)], "event_id long, timestamp timestamp")
    modes = spark.createDataFrame(log, A.MODE_LOG)
    got = {r.event_id: (r.mode, r.session) for r in attach_mode(ev, modes, broadcast_switches=limit).collect()}
    rows = sorted((t, m, s if m != "off" else "") for t, m, _, _, s in log if t is not None)
    for i, t in enumerate(times):
        before = [r for r in rows if r[0] <= _time(t)]
        m, s = (before[-1][1], before[-1][2] or None) if before else ("off", None)
        assert got[i] == (m, s), (i, t)
    assert got[-1] == ("off", None) and len(got) == len(times) + 1
    none = attach_mode(ev, modes.limit(0)).select("mode", "session").distinct().collect()
    assert [tuple(r) for r in none] == [("off", None)]


def test_events_are_not_shuffled_for_a_small_mode_log(spark):
    ev = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 977 + 1704067200).alias("timestamp"))
    modes = spark.createDataFrame([(_time(i * 10 ** 9), "normal", None, None, "s") for i in range(50)], A.MODE_LOG)
    seconds, minutes, hours, facts = mode_steps(modes)
    assert facts["n"] == 50 == sum(len(r["_in_sec"]) for r in seconds.collect())
    out = attach_mode(ev, modes)
    assert out.rdd.getNumPartitions() == ev.rdd.getNumPartitions()       # no exchange between the scan and the result
    assert out.where("mode = 'normal'").count() > 0


def test_cursor_pages_equal_offset_pages(spark, tmp):
    day = "2024-01-10"
    rows = [(i, f"{day}T12:00:{i % 7:02d}+0000", dt.datetime(2024, 1, 10, 12, 0, i % 7) if i % 11 else None) for i in range(100)]
    path = tmp + "/logs"
    spark.createDataFrame(rows, "flow_id long, timestamp_raw string, timestamp timestamp").write.parquet(path)
    ev = spark.read.parquet(path)
    cursor, seen = None, []
    for page in range(1, 9):
        got = EX.logs_after(ev, day, cursor, limit=15)
        ids = [r.flow_id for r in got.collect()]
        assert ids == [r.flow_id for r in EX.logs_by_day(ev, day, page=page, limit=15).collect()]
        seen += ids
        cursor = EX.cursor_of(got)
    assert sorted(seen) == list(range(100)) and cursor is None
    plan = EX.logs_after(ev, day, (dt.datetime(2024, 1, 10, 12, 0, 3), 50), 15)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "TakeOrderedAndProject" in plan


def test_stored_keys_are_not_shuffled(spark, tmp):
    rows = [(f"h{i}", dt.datetime(2024, 1, 1 + i % 3), i) for i in range(300)]
    df = IG.with_event_date(spark.createDataFrame(rows, "event_hash string, timestamp timestamp, flow_id long"))
    df.where("flow_id < 200").write.partitionBy("event_date").parquet(tmp + "/stored")
    stored = spark.read.parquet(tmp + "/stored").select("event_date", "event_hash")
    for limit in (IG.BROADCAST_HASHES, 0):
        new = IG.dedup_new(df.where("flow_id >= 150"), stored, limit)
        assert sorted(r.flow_id for r in new.collect()) == list(range(200, 300))
    plan = IG.dedup_new(df.where("flow_id >= 150"), stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan


def test_prefix_over_ranges(spark):
    rng = random.Random(4)
    rows = {round(rng.uniform(-1, 1), 4): (rng.randint(0, 3), rng.randint(0, 3)) for _ in range(500)}
    df = spark.createDataFrame([(s, *v) for s, v in rows.items()], "score double, pos long, neg long")
    got = {r.score: (r._cum_pos, r._cum_neg) for r in sequence.global_prefix(df, "score", ["pos", "neg"], n_buckets=7).collect()}
    p = n = 0
    for s in sorted(rows):
        p, n = p + rows[s][0], n + rows[s][1]
        assert got[s] == (p, n)
    assert sequence.global_prefix(df.limit(0), "score", ["pos"]).count() == 0


def test_misses_are_written(spark, tmp):
    df = spark.createDataFrame([(f"e{i}", i / 100 - 0.5, i % 2) for i in range(100)], "event_id string, anomaly_score double, gt_label int")
    samples = EV.fn_fp_samples(df, 0.0, n=5)
    A.write_misses(samples, tmp + "/misses")
    for kind in ("fn", "fp"):
        back = {r.event_id for r in spark.read.parquet(f"{tmp}/misses/{kind}").collect()}
        assert len(back) == 5 and back == {r.event_id for r in samples.where(f"kind = '{kind}'").collect()}
        assert spark.read.option("header", True).csv(f"{tmp}/misses/{kind}_csv").count() == 5


def test_equal_switch_times_have_one_session(spark, tmp):
    p = tmp + "/modes"
    for s in ("b", "c", "a"):
        A.append_mode(spark, p, "normal", s, at="2024-01-01 00:00:00")
    assert A.append_mode(spark, p, "anomaly", at="2024-01-02 00:00:00") == "c"


def _follow(spark, path, out, ckpt, **kw):
    q = (growing.follow(spark, path, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted(r.value for r in spark.read.schema("value string").parquet(out).collect())


def test_growing_file_is_read_on(spark, tmp, monkeypatch):
    path, out, ckpt = (os.path.join(tmp, n) for n in ("eve.json", "out", "ckpt"))

    def append(text):
        with open(path, "a", encoding="utf-8") as f:
            f.write(text)
    append("old 1\nold 2\n")
    assert _follow(spark, path, out, ckpt) == []                            # from its end on
    append("a\nb\nhalf")
    assert _follow(spark, path, out, ckpt) == ["a", "b"]
    append(" line é\n\nc\n")
    assert _follow(spark, path, out, ckpt) == ["", "a", "b", "c", "half line é"]
    append("last of the old\n")
    os.rename(path, path + ".1")
    append("new 1\n")
    want = ["", "a", "b", "c", "half line é", "last of the old", "new 1"]
    assert _follow(spark, path, out, ckpt) == want
    with open(path, "w", encoding="utf-8") as f:                            # cut off and written anew
        f.write("x\n")
    with pytest.raises(Exception, match="cannot be found"):
        _follow(spark, path, out, ckpt)
    assert _follow(spark, path, out, ckpt, lossy=True) == sorted([*want, "x"])
    assert _follow(spark, path, out, ckpt, lossy=True) == sorted([*want, "x"])


def test_ranges_of_a_growing_file_share_no_line(tmp, monkeypatch):
    rng = random.Random(2)
    lines = ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    path = os.path.join(tmp, "log")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\nunfinished")
    for size, step in ((1, 7), (13, 5), (100, 64), (10 ** 6, 1 << 16)):
        monkeypatch.setattr(growing, "RANGE_BYTES", size)
        monkeypatch.setattr(growing, "_STEP", step)
        reader = growing._Follower({"path": path, "startingposition": "start"})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [x[0] for p in parts for x in reader.read(p)] == lines
