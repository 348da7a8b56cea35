"""Processed ledger by day.

The ledger has the ids of processed events, partitioned by ``event_date`` and
batch.  A day whose events are all in the ledger is closed: neither its events
nor its ledger rows are read again.  A closed day is remembered with the mark
of its stored files; when late events add a file, the mark differs and the day
is open again.  Marks come from the file system, not from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth.operators.explore import first_n
from netsleuth.schemas import SERVING_COLUMNS
from netsleuth.session import exists
from netsleuth.sources import versions

_ROWS = "event_id string, processed_at timestamp, event_date date, batch long"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class Ledger:
    """The ledger below ``path`` of the store ``store_path``, which is
    partitioned by ``event_date``."""

    def __init__(self, spark: SparkSession, path: str, store_path: str):
        self.spark, self.path, self.store_path = spark, path, store_path

    def rows(self) -> DataFrame:
        """``(event_id, processed_at, event_date, batch)``."""
        where = f"{self.path}/rows"
        if not exists(self.spark, where):
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(where)

    def closed(self) -> dict[str, str]:
        """Closed days and the marks they were closed with; one row a day."""
        version = versions.current(self.spark, f"{self.path}/closed")
        if version is None:
            return {}
        return {r["day"]: r["mark"] for r in self.spark.read.parquet(versions.folder(f"{self.path}/closed", version)).collect()}

    def open_days(self) -> list[str]:
        """Days of the store that are not closed or have changed since."""
        done = self.closed()
        return sorted(d for d, mark in versions.day_marks(self.spark, self.store_path).items() if done.get(d) != mark)

    @staticmethod
    def _of_days(df: DataFrame, days: list[str]) -> DataFrame:
        """The partitions of ``days``; days are dates or the one without."""
        known = [F.lit(d).cast("date") for d in days if d != _NO_DAY]
        cond = F.col("event_date").isin(known) if known else F.lit(False)
        return df.where(cond | F.col("event_date").isNull() if _NO_DAY in days else cond)

    def stored(self, days: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.store_path)
        return df if days is None else self._of_days(df, days)

    def pending(self, n: int | None = None) -> DataFrame:
        """Stored events of open days that the ledger lacks, in the serving
        projection with ``event_date``; the oldest ``n`` of them if given.  Both
        scans read the open days' partitions only."""
        days = self.open_days()
        events = self.stored(days)
        events = events.select(*[c for c in SERVING_COLUMNS if c in events.columns], "event_date")
        done = self._of_days(self.rows(), days).select(F.col("event_id").alias("_id"))
        left = events.join(done, events["event_id"] == done["_id"], "left_anti")
        return first_n(left, n) if n else left

    def mark(self, ids: DataFrame, batch: int, at=None) -> None:
        """K7: append a batch ``(event_id, event_date)``.  A batch that is
        marked again replaces its own rows, so each event is in once."""
        ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        rows = ids.select(F.col("event_id").cast("string").alias("event_id"), ts.alias("processed_at"), "event_date", F.lit(batch).cast("long").alias("batch"))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(f"{self.path}/rows"))

    def close(self, batch: int) -> list[str]:
        """Close the open days whose stored events are all in the ledger; the
        marks are read before the counts, so a day that grows meanwhile opens
        again.  -> the days closed."""
        done = self.closed()
        marks = {d: m for d, m in versions.day_marks(self.spark, self.store_path).items() if done.get(d) != m}
        if not marks:
            return []
        day = F.coalesce(F.col("event_date").cast("string"), F.lit(_NO_DAY)).alias("day")
        stored = self.stored(list(marks)).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
        known = self._of_days(self.rows(), list(marks)).groupBy(day).agg(F.count(F.lit(1)).alias("m"))
        full = [r["day"] for r in stored.join(known, "day").where("n = m").select("day").collect()]       # open days only
        if full:
            table = [(d, m) for d, m in {**done, **{d: marks[d] for d in full}}.items()]
            versions.publish(self.spark, f"{self.path}/closed", batch,
                             lambda target: self.spark.createDataFrame(table, "day string, mark string").coalesce(1).write.mode("overwrite").parquet(target))
        return full
