"""Rule text pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt2(x) -> Column:
    """Two decimals, HALF_UP on the shortest decimal text (Spark/Java rule)."""
    return F.format_string("%.2f", _col(x).cast("double"))


def num_text(x, places: int) -> Column:
    """Text of ``round(x, places)`` as a double (e.g. '-0.1', '0.125')."""
    return F.round(_col(x).cast("double"), places).cast("string")


def header(text) -> Column:
    """text before the first '(' , trimmed."""
    return F.trim(F.split_part(_col(text), F.lit("("), F.lit(1)))


def sid_of(text) -> Column:
    """The numeric ``sid:`` option of a rule line (NULL if absent)."""
    return F.regexp_extract(_col(text), r"sid:\s*(\d+)\s*;", 1).try_cast("bigint")


def is_comment(text) -> Column:
    return _col(text).startswith("#")


def is_managed(text) -> Column:
    """Rules this library writes per address (``drop ip``/``alert ip``)."""
    return _col(text).rlike(r"^(drop|alert) ip")
