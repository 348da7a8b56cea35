"""Exploration.

Everything is a bounded top-k or an aggregate; no operator sorts a whole
table into one task or brings rows to the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.clock import wall_clock_date
from netsleuth.functions.scalar import coerce_numeric
from netsleuth.schemas import MODEL_FEATURES, SERVING_COLUMNS


def _of_day(events: DataFrame, day: dt.date | str, raw_col: str) -> DataFrame:
    """Events of one calendar day, as written in their own offset."""
    d = events.where(wall_clock_date(raw_col) == F.lit(str(day)).cast("date"))
    if "event_date" in events.columns:  # the UTC date is at most a day off: prunes partitions
        on = F.lit(str(day)).cast("date")
        d = d.where(F.col("event_date").between(F.date_sub(on, 1), F.date_add(on, 1)))
    return d


def logs_by_day(events: DataFrame, day: dt.date | str, page: int = 1, limit: int = 100,
                raw_col: str = "timestamp_raw", ts_col: str = "timestamp", tie_col: str = "flow_id") -> DataFrame:
    """P16 + L1: events of one calendar day (as written in their own offset),
    newest first, page ``page`` of ``limit``, with the day's ``total``.

    ``orderBy().offset().limit()`` runs as a per-partition top-(page*limit)
    and a merge; the total is a scalar subquery.  ``logs_after`` pages without
    that growth."""
    d = _of_day(events, day, raw_col)
    total = d.agg(F.count(F.lit(1))).scalar()
    start = (page - 1) * limit
    ordered = d.orderBy(F.col(ts_col).desc_nulls_last(), F.col(tie_col).desc())
    paged = ordered.offset(start).limit(limit) if start else ordered.limit(limit)
    return paged.withColumn("page", F.lit(page)).withColumn("limit", F.lit(limit)).withColumn("total", total)


def logs_after(events: DataFrame, day: dt.date | str, cursor: tuple | None = None, limit: int = 100,
               raw_col: str = "timestamp_raw", ts_col: str = "timestamp", tie_col: str = "flow_id") -> DataFrame:
    """P16 + L1 by cursor: the next ``limit`` events of the day behind
    ``cursor``, the (time, tie) of the last row seen, in the order of
    ``logs_by_day``; None starts at the newest.

    The cursor is a filter that reaches the scan, and each task keeps ``limit``
    rows: page 1,000 costs what page 1 costs.  ``tie_col`` must be unique among
    events of one time."""
    d = _of_day(events, day, raw_col)
    if cursor is not None:
        at, tie = cursor
        behind = F.col(tie_col) < F.lit(tie)
        if at is None:
            d = d.where(F.col(ts_col).isNull() & behind)
        else:
            at = F.lit(at).cast(events.schema[ts_col].dataType)
            d = d.where((F.col(ts_col) < at) | ((F.col(ts_col) == at) & behind) | F.col(ts_col).isNull())
    return d.orderBy(F.col(ts_col).desc_nulls_last(), F.col(tie_col).desc()).limit(limit)


def cursor_of(page: DataFrame, ts_col: str = "timestamp", tie_col: str = "flow_id") -> tuple | None:
    """The cursor behind a page of ``logs_after``; None if the page is empty."""
    last = page.orderBy(F.col(ts_col).asc_nulls_first(), F.col(tie_col).asc()).select(ts_col, tie_col).first()
    return None if last is None else (last[0], last[1])


def first_n(df: DataFrame, n: int, ts_col: str = "timestamp", tie_col: str = "event_id") -> DataFrame:
    """L2: the ``n`` oldest rows, ordered (unlike the reference's unordered cap)."""
    return df.orderBy(F.col(ts_col).asc_nulls_first(), F.col(tie_col).asc()).limit(n)


def preview(df: DataFrame, n: int = 50, order_col: str = "event_id") -> DataFrame:
    """L4: deterministic head of a table."""
    return df.orderBy(order_col).limit(n)


def unprocessed(stored: DataFrame, ledger: DataFrame, n: int | None = None,
                key: str = "event_id") -> DataFrame:
    """S4 + L2 + J10: stored events not yet in the processed ledger, the
    serving projection; with a batch size ``n`` the oldest ``n`` of them.

    The batch's ids are what K7 appends to the ledger (``mark_processed``)."""
    d = stored.select(*[c for c in SERVING_COLUMNS if c in stored.columns]) \
              .join(ledger.select(key).distinct(), key, "left_anti")
    return first_n(d, n) if n else d


def mark_processed(batch: DataFrame, at=None, key: str = "event_id") -> DataFrame:
    """K7: ledger rows for a processed batch."""
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return batch.select(key).withColumn("processed_at", ts)


def sessions(stored: DataFrame) -> DataFrame:
    """A11 + L5: training sessions with their size, last event time and
    whether it is the latest (by last event time, then id)."""
    s = stored.where(F.coalesce(F.col("training_mode"), F.lit(False)) & F.col("training_session").isNotNull()) \
              .groupBy("training_session").agg(F.count(F.lit(1)).alias("n_events"),
                                               F.max("timestamp").alias("last_ts"))
    latest = s.agg(F.max_by("training_session", F.struct("last_ts", "training_session"))).scalar()
    return s.withColumn("is_latest", F.col("training_session") == latest)


def dashboard(scored: DataFrame) -> DataFrame:
    """Total events, predicted anomalies and their percentage."""
    anomalous = F.col("prediction") == K.ANOMALY_PREDICTION
    return scored.agg(F.count(F.lit(1)).alias("total_events"), F.count_if(anomalous).alias("anomalies_detected")) \
                 .withColumn("anomaly_percentage",
                             F.col("anomalies_detected") * F.lit(100.0) / F.nullif(F.col("total_events"), F.lit(0)))


def top_sources(scored: DataFrame, n: int = 5) -> DataFrame:
    """Sources with the most predicted anomalies (ties by address)."""
    return (scored.where(F.col("prediction") == K.ANOMALY_PREDICTION)
                  .groupBy("src_ip").agg(F.count(F.lit(1)).alias("count"))
                  .orderBy(F.col("count").desc(), F.col("src_ip").asc()).limit(n))


def align_features(df: DataFrame, features=MODEL_FEATURES, keep=("event_id",)) -> DataFrame:
    """P6 + P7: the model's feature list as DOUBLE; present columns coerced
    (non-numeric, NULL, NaN -> 0), missing columns 0."""
    cols = [coerce_numeric(c).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features]
    return df.select(*[F.col(k) for k in keep if k in df.columns], *cols)


def training_rows(features: DataFrame, label_col: str = "training_label",
                  feature_cols=MODEL_FEATURES, keep=("event_id",)) -> DataFrame:
    """P8 + P9: rows labelled normal (when a label exists), identifier and
    label columns dropped."""
    d = features
    if label_col in d.columns:
        d = d.where(F.lower(F.col(label_col).cast("string")) == K.LABEL_NORMAL)
    return d.select(*[k for k in keep if k in d.columns], *feature_cols)
