"""Time parsing.

Timestamps arrive as ISO-8601 text with an offset (``+0200``, ``+02:00`` or
``Z``).  The instant is parsed to a UTC TIMESTAMP; the written offset is kept
because the hour features use the wall-clock hour *as written*.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsleuth import constants as K

ISO_OFFSET_PATTERN = r"([+-]\d{2}:?\d{2}|Z)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(raw) -> Column:
    """ISO-8601 text -> TIMESTAMP; unparsable (e.g. 'Desconocido') -> NULL."""
    return F.try_to_timestamp(_col(raw))


def utc_offset(raw) -> Column:
    return F.when(parse_ts(raw).isNotNull(), F.regexp_extract(_col(raw), ISO_OFFSET_PATTERN, 1))


def wall_clock_hour(raw) -> Column:
    """Hour as written in the event's own offset; unparsable -> 0."""
    raw = _col(raw)
    h = F.substring(raw, 12, 2).try_cast("int")
    return F.coalesce(F.when(parse_ts(raw).isNotNull(), h), F.lit(0))


def wall_clock_date(raw) -> Column:
    """Calendar day as written in the event's own offset; unparsable -> NULL."""
    raw = _col(raw)
    return F.when(parse_ts(raw).isNotNull(), F.substring(raw, 1, 10).try_cast("date"))


def hour_of(ts) -> Column:
    """Hour of a TIMESTAMP in the session zone (UTC); NULL -> 0."""
    return F.coalesce(F.hour(_col(ts)), F.lit(0))


def is_night(hour) -> Column:
    h = _col(hour)
    return F.when((h < K.NIGHT_BEFORE_HOUR) | (h > K.NIGHT_AFTER_HOUR), 1).otherwise(0)


def micros(ts) -> Column:
    """Microseconds since the epoch; accepts TIMESTAMP (UTC session)."""
    return F.unix_micros(_col(ts).cast("timestamp"))
