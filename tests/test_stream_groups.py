"""State of the streaming counts: groups of sources, not single sources."""

import datetime as dt
import os

import pytest

from netsleuth.streaming import windows as SW

T0 = dt.datetime(2024, 1, 1, 10, 0)


def _run(spark, tmp, counts):
    rows = [(f"e{i}", None if i % 50 == 49 else f"10.0.{i % 997 // 250}.{i % 997 % 250}", T0 + dt.timedelta(seconds=7 * (i % 130))) for i in range(3000)]
    src, out, ckpt = (os.path.join(tmp, x) for x in ("src", "out", "ckpt"))
    schema = "event_id string, src_ip string, timestamp timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stored = spark.read.parquet(src)
    state = 0
    for last in (False, True):
        if last:
            SW.closing_marker(spark, stored.schema, max(r[2] for r in rows)).write.mode("append").parquet(src)
        with SW.keyed_state(spark):
            q = (counts(spark.readStream.schema(stored.schema).parquet(src)).writeStream.outputMode("append").format("parquet")
                 .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        state = max([state, *(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])])
    return rows, spark.read.parquet(out), state


@pytest.mark.parametrize("exact", [True, False])
def test_state_of_many_sources_is_kept_by_group(spark, tmp, exact):
    rows, got, state = _run(spark, tmp, SW.exact_trailing_counts if exact else SW.sliding_counts)
    assert 0 < state <= 8 * SW.GROUPS                         # 997 sources in 6 windows of 10 minutes
    five = dt.timedelta(minutes=5)
    if exact:
        want = {i: 0 if s is None else sum(1 for _, s2, t2 in rows if s2 == s and t - five < t2 <= t) for i, s, t in rows}
        found = got.collect()
        assert len(found) == len(rows) and {r.event_id: r.conn_5m for r in found} == want
    else:
        want = {}
        for _, s, t in rows:
            for k in range(5):
                at = (t.replace(second=0) - dt.timedelta(minutes=k), s)
                want[at] = want.get(at, 0) + 1
        found = got.selectExpr("cast(window_start as timestamp_ntz) a", "cast(window_end as timestamp_ntz) z", "src_ip", "n").collect()
        assert len(found) == len(want) and {(r.a, r.src_ip): r.n for r in found} == want and all(r.z - r.a == five for r in found)
