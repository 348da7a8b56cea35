"""Work that was done several times over: parses, tables and rank windows."""

import io
import os
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from netsleuth.operators import ingest as IG
from netsleuth.operators import sequence
from netsleuth.sources import artifacts as A


def test_a_line_is_parsed_once_for_its_check_and_once_for_its_fields(spark):
    lines = spark.createDataFrame([("{}",)], "value string")
    text = io.StringIO()
    with redirect_stdout(text):
        IG.flatten(IG.parse_lines(lines)).explain()
    plan = text.getvalue()
    assert plan.count("from_json(") == 1 and plan.count("parseJson(") == 1 and "jsonObjectKeys" not in plan


def test_whole_lines_pass_and_others_do_not(spark):
    good = ['{}', ' \t{"flow_id":1}\r', '{"a":{"b":[1,2]}}', '{"flow_id":"x"}']
    bad = ['', ' ', None, '[]', '[{"a":1}]', '1', '"{}"', 'null', '{"a":1', '{"a":1}x', '{"a":1}{"a":1}', '{"a":1} {"a":1}', '{"a":1},{"a":2}', '{}}', '{"a":1,"a":2']
    d = IG.parse_lines(spark.createDataFrame([(v,) for v in good + bad], "value string"))
    assert {r.value for r in d.where("not _corrupt").collect()} == set(good)
    assert {r.value for r in IG.quarantine(d).collect()} == set(bad)
    assert d.where("not _corrupt and e is null").count() == 0


def test_csv_beside_parquet_does_not_compute_the_table_again(spark, tmp):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def once(x):
        calls.add(1)
        return x
    A.write_table(spark.range(20).coalesce(1).select(once("id").alias("x")), os.path.join(tmp, "t"), csv=True)
    assert calls.value == 20
    assert spark.read.option("header", True).csv(os.path.join(tmp, "t_csv")).count() == 20


def test_positions_rank_a_key_over_several_batches_and_partitions(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = spark.range(200).selectExpr("case when id % 5 < 3 then 'a' when id % 5 = 3 then 'b' end as k", "case when id % 11 > 0 then id div 4 end as t", "id", "id % 3 as s")
        got = sequence.positions(d, "k", "t", "id", sums=["s"], parts=3)
        rows = sorted(got.collect(), key=lambda r: (r.k or "", r.k is not None, r.t is not None, r.t or 0, r.id))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    at, total = {}, {}
    for r in rows:
        total[r.k] = total.get(r.k, 0) + r.s
        assert (r._pos, r._cum_s) == (at.get(r.k, 0), total[r.k])
        at[r.k] = at.get(r.k, 0) + 1
    assert len(rows) == 200 and got.columns == ["k", "t", "id", "s", "_pos", "_cum_s"]


def test_ranges_are_ranked_without_another_shuffle_of_the_rows(spark):
    text = io.StringIO()
    with redirect_stdout(text):
        sequence.positions(spark.range(9).selectExpr("'a' as k", "id as t", "id"), "k", "t", "id").explain()
    assert "row_number" not in text.getvalue()


def _events_file(spark, folder, n=40):
    """One small file of own events; every second one is a mode switch."""
    d = spark.range(n).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) as ts",
                                  "id % 5 as user_id", "case when id % 3 = 0 then 'error' else 'click' end as event_type",
                                  "cast(id as double) as value", "concat('{\"k\": ', id % 4, '}') as props")
    d.coalesce(1).write.parquet(os.path.join(folder, "events.parquet"))
    return folder


def test_stream_reads_a_stored_mode_log_and_not_the_events_in_every_batch(spark, tmp, monkeypatch):
    from netsleuth.plans import q_stream
    from netsleuth.sources.flowview import load_table, mode_log
    seen, start = [], q_stream.SI.start_ingest

    def watched(*args, **kw):
        seen.append(kw["modes"])
        return start(*args, **kw)
    monkeypatch.setattr(q_stream.SI, "start_ingest", watched)
    sf = _events_file(spark, tmp)
    assert q_stream.stream_ingest(spark, sf).count() > 0
    text = io.StringIO()
    with redirect_stdout(text):
        seen[0].explain()
    assert "events.parquet" not in text.getvalue() and "get_json_object" not in text.getvalue()
    want = mode_log(load_table(spark, sf, "events"))
    assert seen[0].count() == 20 and sorted(map(str, seen[0].collect())) == sorted(map(str, want.collect()))


def test_lines_are_made_by_all_cores_from_one_file(spark, tmp, monkeypatch):
    from netsleuth.sources import flowview
    seen, make = [], flowview.raw_lines

    def watched(events):
        seen.append(events)
        return make(events)
    monkeypatch.setattr(flowview, "raw_lines", watched)
    sf = _events_file(spark, tmp)
    path = flowview.raw_line_files(spark, sf)
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    want = make(flowview.load_table(spark, sf, "events"))
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(r.value for r in want.collect())
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 8
