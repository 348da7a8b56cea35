"""Event sources: JSON-lines logs (batch), stored event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth.operators import ingest as IG


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sensor log folder -> ``(value STRING)``, one row per line."""
    return spark.read.text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Sensor log folder -> flattened events (malformed lines dropped; use
    ``quarantined`` to keep them)."""
    return IG.flatten(IG.parse_lines(read_lines(spark, path)))


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    return IG.quarantine(IG.parse_lines(read_lines(spark, path)))


def recent_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Parsed events, newest first (by event time, then text); at most ``n``
    if that is given."""
    ev = read_events(spark, path)
    ev = ev.orderBy(F.col("timestamp").desc_nulls_last(), F.col("timestamp_raw").desc())
    return ev.limit(n) if n else ev


def stored_events(spark: SparkSession, path: str, training_session: str | None = None,
                  training_only: bool = False, max_rows: int | None = None) -> DataFrame:
    """Scan the stored table with the optional session predicate
    (pushed to the Parquet reader).  No row cap unless ``max_rows`` is given,
    and then the oldest rows in (timestamp, event_id) order (Q1)."""
    df = spark.read.parquet(path)
    if training_only or training_session is not None:
        df = df.where(F.col("training_mode"))
    if training_session is not None:
        df = df.where(F.col("training_session") == training_session)
    if max_rows:
        df = df.orderBy(F.col("timestamp").asc_nulls_first(), F.col("event_id").asc()).limit(max_rows)
    return df


def write_stored(df: DataFrame, path: str, mode: str = "append") -> None:
    """K1 sink: append to the stored table partitioned by event date."""
    if "event_date" not in df.columns:
        df = IG.with_event_date(df)
    df.write.mode(mode).partitionBy("event_date").parquet(path)
