"""Streaming per-source connection counts.

The batch feature ``conn_5m`` is an exact trailing window per row.  On a
stream the bounded-state form is a sliding event-time window: counts per
source over 5-minute windows sliding by 1 minute, finalised by a watermark
(later rows are left to the batch operator on the stored table)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore."
#: State on local disk; the native memory of all stores of an executor is bounded together.
_STORE_CONF = {_STORE + "providerClass": ROCKSDB, _STORE + "rocksdb.boundedMemoryUsage": "true", _STORE + "rocksdb.maxMemoryUsageMB": "600",
               _STORE + "rocksdb.changelogCheckpointing.enabled": "true"}
#: Sources of a time bucket share its groups by hash, so that groups stay few when sources are many.
GROUPS = 64


@contextmanager
def keyed_state(spark):
    """The state store on disk, for queries started inside; a started query
    keeps the store it was started with.  The default store holds every key on
    the executors' heaps."""
    before = {name: spark.conf.get(name, None) for name in _STORE_CONF}
    for name, value in _STORE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _groups(rows: DataFrame, ts_col: str, key: str, row, width: int, bucket: int, watermark: str) -> DataFrame:
    """``(x_start, x_rows)``: the collected ``row`` of each event-time window
    over a time bucket and the ``width`` seconds beside it, by groups of sources;
    a window comes out once the watermark has passed its end."""
    return (rows.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, f"{width + bucket} seconds", f"{bucket} seconds").alias("w"),
                     F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("g"))
            .agg(F.collect_list(row).alias("x_rows"))
            .select(F.unix_micros(F.col("w.start")).alias("x_start"), "x_rows"))


def _by_group(batches):
    """Parts of a few hundred groups: (rows, group of each, start of each)."""
    import numpy as np
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = part.column("x_rows").flatten()
            if len(rows):
                group = np.repeat(np.arange(part.num_rows), part.column("x_rows").value_lengths().to_numpy(zero_copy_only=False))
                yield rows, group, part.column("x_start").to_numpy(zero_copy_only=False)[group]


def sliding_counts(events: DataFrame, ts_col: str = "timestamp", key: str = "src_ip",
                   width: str = "5 minutes", slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Counts per source over windows of ``width`` that start every ``slide``.

    The state has the rows by (time bucket, group of sources), each twice, in
    place of a counter for every source and window; the windows that start in a
    bucket are counted when the watermark has passed the bucket's last one."""
    import pandas as pd
    long, step = (int(pd.Timedelta(x).total_seconds()) for x in (width, slide))
    bucket = -(-long // step) * step
    row = F.struct(F.unix_micros(ts_col).alias("t"), F.col(key).alias("s"))
    rows = events.where(F.col(ts_col).isNotNull()).select(F.col(ts_col).cast("timestamp").alias(ts_col), F.col(key).cast("string").alias(key))
    return _groups(rows, ts_col, key, row, long, bucket, watermark).mapInArrow(
        _slide_groups(key, long * 1_000_000, step * 1_000_000, bucket * 1_000_000), f"window_start timestamp, window_end timestamp, {key} string, n long")


def _slide_groups(key_col: str, width: int, step: int, bucket: int):
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for rows, group, start in _by_group(batches):
            source, t = rows.field("s").dictionary_encode(), rows.field("t").to_numpy(zero_copy_only=False)
            code = source.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            last = t // step * step
            begins = last[:, None] - step * np.arange(-(-width // step))
            inside = (begins >= start[:, None]) & (begins < start[:, None] + bucket) & (t[:, None] < begins + width)
            row, _ = np.nonzero(inside)
            key = np.stack([begins[inside], group[row], code[row]])
            found, n = np.unique(key, axis=1, return_counts=True)
            at = pa.array(found[2] - 1, pa.int64(), mask=found[2] == 0)
            when = lambda x: pa.array(x).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([when(found[0]), when(found[0] + width), source.dictionary.take(at), pa.array(n.astype(np.int64))],
                                             ["window_start", "window_end", key_col, "n"])
    return run


def start_sliding_counts(events: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None, **kw):
    with keyed_state(events.sparkSession):
        q = (sliding_counts(events, **kw).writeStream.outputMode("append").format("parquet")
             .option("path", out_path).option("checkpointLocation", checkpoint))
        return q.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def _count_groups(id_col: str, key_col: str, ts_col: str, width: int):
    """Batches of ``(x_start, x_rows)`` -> the trailing count of the rows behind
    the first ``width`` of each group; those before are only looked back to."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for rows, group, start in _by_group(batches):
            source, t = rows.field("s"), rows.field("t").to_numpy(zero_copy_only=False)
            code = source.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            since = t - start
            own = np.flatnonzero(since >= width)
            span = int(since.max()) + 1
            place = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1] * span     # sources of groups side by side
            times = np.sort(place + since)
            upto = (place + since)[own]
            n = np.searchsorted(times, upto, "right") - np.searchsorted(times, upto - width, "right")
            keep = pa.array(own)
            yield pa.RecordBatch.from_arrays([rows.field("i").take(keep), source.take(keep), pa.array(t[own]).cast(pa.timestamp("us", "UTC")),
                                              pa.array(n.astype(np.int64))], [id_col, key_col, ts_col, "conn_5m"])
    return run


def exact_trailing_counts(events: DataFrame, ts_col: str = "timestamp", key: str = "src_ip",
                          id_col: str = "event_id", seconds: int = 300, watermark: str = "10 minutes",
                          bucket_seconds: int | None = None) -> DataFrame:
    """Exact streaming twin of ``conn_5m``: rows of the same source in
    ``(t - width, t]`` for every event.  Start it within ``keyed_state``.

    An event-time window reaches over a time bucket (``bucket_seconds``, by
    default the width) and the width before it, which is all that the bucket
    looks back to.  The state has the rows of each (window, group of sources):
    a busy source is spread over its buckets, and quiet sources share a group,
    so there is no state or timer per source and minute.  A window leaves the
    state once the watermark has passed its end (no earlier row can still
    arrive); its rows are counted then, many groups at a time.  Rows without
    time or source are emitted at once with 0, as in the batch operator; rows
    later than the watermark are dropped by Spark and left to ``conn_5m`` on the
    stored table.  ``closing_marker`` lets a finite stream release its last rows.
    """
    bucket = bucket_seconds or seconds
    schema = f"{id_col} string, {key} string, {ts_col} timestamp, conn_5m long"
    whole = F.col(ts_col).isNotNull() & F.col(key).isNotNull()
    named = [F.col(id_col).cast("string").alias(id_col), F.col(key).cast("string").alias(key), F.col(ts_col).cast("timestamp").alias(ts_col)]
    at_once = events.where(~whole & F.col(id_col).isNotNull()).select(*named, F.lit(0).cast("long").alias("conn_5m"))
    # no filter here: the optimiser would move it below the watermark and hide rows from it
    row = F.when(F.col(key).isNotNull(), F.struct(F.unix_micros(ts_col).alias("t"), F.col(id_col).alias("i"), F.col(key).alias("s")))
    groups = _groups(events.select(*named), ts_col, key, row, seconds, bucket, watermark)
    counted = groups.mapInArrow(_count_groups(id_col, key, ts_col, seconds * 1_000_000), schema)
    return counted.unionByName(at_once)


def closing_marker(spark, schema, newest, ts_col: str = "timestamp", seconds: int = 300, watermark_minutes: int = 10) -> DataFrame:
    """One row without source and id whose time moves the watermark past every
    window that holds an event up to ``newest``.  Written behind the last file
    of a finite stream, it releases what append mode holds back."""
    late = F.lit(newest).cast("timestamp") + F.make_dt_interval(mins=F.lit(watermark_minutes + 3 * seconds // 60 + 1))
    cols = [late.cast(f.dataType).alias(f.name) if f.name == ts_col else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(1).select(*cols)
