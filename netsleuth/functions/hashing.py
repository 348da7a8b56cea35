"""Hashes and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsleuth import constants as K

NONE_TEXT = K.MISSING_IN_KEY     # how a missing value is printed inside hashed keys


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(NONE_TEXT))


def event_hash(columns: Sequence) -> Column:
    """SHA-256 hex of the given fields joined by '|', NULL printed as 'None'."""
    return F.sha2(F.concat_ws(K.HASH_SEPARATOR, *[_text(c) for c in columns]), 256)


def fallback_event_id(src_ip, dest_ip, raw_timestamp) -> Column:
    """MD5 hex of 'src-dest-timestamp' for events without a stored id."""
    return F.md5(F.concat_ws(K.FALLBACK_ID_SEPARATOR, _text(src_ip), _text(dest_ip), _text(raw_timestamp)))


def sha_mod(text, modulus: int, base: int = 0) -> Column:
    """``base + int(sha256(text), 16) % modulus`` exactly, in BIGINT.

    Horner's rule over the 8 32-bit chunks of the digest keeps every
    intermediate below modulus * 2**32.
    """
    from netsleuth.functions.ip import let

    def horner(h: Column) -> Column:
        acc = F.lit(0).cast("bigint")
        for i in range(8):
            chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")
            acc = F.pmod(acc * F.lit(2 ** 32) + chunk, F.lit(modulus))
        return acc

    return let(F.sha2(_col(text), 256), horner) + F.lit(base)


def session_id_from_time(label, ts) -> Column:
    """'<label>-yyyyMMdd-HHmm' in UTC."""
    return F.concat_ws("-", _col(label), F.date_format(_col(ts), K.SESSION_TIME_FORMAT))


def session_id_random(mode, ts) -> Column:
    """First 16 hex digits of SHA-256('<mode>-<epoch seconds>')."""
    secs = (F.unix_micros(_col(ts)) / F.lit(1_000_000.0)).cast("string")
    return F.substring(F.sha2(F.concat_ws("-", _col(mode), secs), 256), 1, K.SESSION_RANDOM_HEX)
