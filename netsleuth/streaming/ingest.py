"""Continuous ingest (T1-T5): sensor log folder -> stored events table.

``readStream.text`` over a folder of rolled log files (Spark's file source
reads each file once, so the sensor log must be rotated into the folder),
then the same parse / flatten / mode lookup / admission / hashing functions
as the batch path, and a ``foreachBatch`` sink that appends only events
whose hash is not stored yet.

Exactly-once: offsets live in the checkpoint; a retried micro-batch re-runs
the anti-join against the stored table, so rows written by a failed attempt
are not appended twice.  The anti-join reads only the ``event_date``
partitions present in the micro-batch, so history never has to be kept in
streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.operators import ingest as IG
from netsleuth.operators.modes import attach_mode
from netsleuth.schemas import MODE_LOG
from netsleuth.session import exists


def stream_lines(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of log lines."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def admitted_events(lines: DataFrame, modes: DataFrame | None = None, compat_hash: bool = False) -> DataFrame:
    """Lines of one micro-batch -> admitted, labelled, hashed events."""
    return _admitted(IG.parse_lines(lines), modes, compat_hash)


def _admitted(parsed: DataFrame, modes: DataFrame | None, compat_hash: bool) -> DataFrame:
    flat = IG.flatten(parsed)
    if modes is not None:
        flat = attach_mode(flat, modes)
    else:
        flat = flat.withColumn("mode", F.lit(K.MODE_OFF)).withColumn("session", F.lit(None).cast("string"))
    hashed = IG.with_event_hash(IG.admit(IG.label(flat)), compat=compat_hash)
    return IG.with_event_date(IG.with_event_id(hashed))


def append_new(batch: DataFrame, stored_path: str, rows_per_file: int = 1_000_000) -> None:
    """T2 + K1 for one micro-batch: de-duplicate inside the batch, drop hashes
    already stored for the batch's dates, append the rest.

    The batch is kept while its dates are read and its rows written, so its
    lines are parsed once.  A date's rows are spread over as many files as
    ``rows_per_file`` asks for, so that no task writes a whole day."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        days = batch.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).collect()   # a few dates per batch
        stored = None
        if exists(spark, stored_path):
            known = [d[0] for d in days if d[0] is not None]
            cond = F.col("event_date").isin(known) if known else F.lit(False)
            if any(d[0] is None for d in days):
                cond = cond | F.col("event_date").isNull()
            stored = spark.read.parquet(stored_path).where(cond).select("event_date", "event_hash")
        new = IG.dedup_new(batch, stored)
        files = F.lit(1)                                  # of each date by its own rows
        for d in days:
            if d["n"] > rows_per_file:
                files = F.when(F.col("event_date").eqNullSafe(F.lit(d["event_date"])), -(-d["n"] // rows_per_file)).otherwise(files)
        spread = F.pmod(F.xxhash64("event_hash"), files)
        new.repartition("event_date", spread).write.mode("append").partitionBy("event_date").parquet(stored_path)
    finally:
        batch.unpersist()


def ingest_batch(lines: DataFrame, stored_path: str, modes=None, quarantine_path: str | None = None,
                 epoch: int = 0, compat_hash: bool = False) -> None:
    """One micro-batch of lines: malformed ones to the quarantine, the others
    labelled with the mode in force at their own time and stored if new.

    ``modes``: a mode-log table, the path of one, or a function of the session
    that returns one.  Paths and functions are read anew in each micro-batch,
    so a switch takes effect on the running stream.  The quarantine has one
    folder per micro-batch, which a retried batch writes over."""
    spark = lines.sparkSession
    if callable(modes):
        modes = modes(spark)
    elif isinstance(modes, str):
        modes = spark.read.schema(MODE_LOG).parquet(modes) if exists(spark, modes) else None
    parsed = IG.parse_lines(lines)
    if quarantine_path:
        IG.quarantine(parsed).write.mode("overwrite").text(f"{quarantine_path}/batch={epoch}")
    append_new(_admitted(parsed, modes, compat_hash), stored_path)


def start_ingest(spark: SparkSession, source_dir: str, stored_path: str, checkpoint: str,
                 modes=None, trigger: dict | None = None, max_files_per_trigger: int | None = None,
                 quarantine_path: str | None = None, compat_hash: bool = False):
    """Start the ingest query.  ``trigger`` defaults to ``{'processingTime':
    '1 second'}`` (the reference polls every second); use
    ``{'availableNow': True}`` for scheduled catch-up runs (T3).  ``modes`` and
    ``quarantine_path`` as in ``ingest_batch``."""
    lines = stream_lines(spark, source_dir, max_files_per_trigger)
    w = (lines.writeStream.foreachBatch(
            lambda b, epoch: ingest_batch(b, stored_path, modes, quarantine_path, epoch, compat_hash))
              .option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"processingTime": "1 second"}))
    return w.start()


def start_rule_schedule(spark: SparkSession, scored_dir: str, schema, on_batch, checkpoint: str,
                        every: str = "5 minutes", trigger: dict | None = None):
    """T4 + T5: run ``on_batch(df, epoch)`` (e.g. rule generation) over newly
    scored files every ``every`` (or a scheduled ``availableNow`` run); the
    checkpoint replaces the 'processed' flag, so every event is consumed once."""
    stream = spark.readStream.schema(schema).parquet(scored_dir)
    return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
                  .trigger(**(trigger or {"processingTime": every})).start())
