"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsleuth import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c) -> Column:
    """Anything -> DOUBLE; non-numeric, NULL and NaN -> 0."""
    v = _col(c).try_cast("double")
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def hour_anomaly_flag(hour, modal_hour, circular: bool = False) -> Column:
    """1 when the hour is more than 3 away from the modal hour.  The reference
    distance is linear (23 vs 0 is 23); ``circular=True`` uses clock distance."""
    d = F.abs(_col(hour) - F.coalesce(_col(modal_hour), F.lit(0)))
    if circular:
        d = F.least(d, F.lit(24) - d)
    return F.when(d > K.HOUR_DEVIATION, 1).otherwise(0)


def pkt_anomaly_flag(length, mean, std) -> Column:
    """1 when |length - mean| > 2 * std; undefined std -> 0."""
    cond = F.abs(_col(length) - _col(mean)) > F.lit(K.PKT_STD_FACTOR) * _col(std)
    return F.coalesce(cond, F.lit(False)).cast("int")


def rarity(freq) -> Column:
    """1 / (1e-6 + frequency); unseen -> frequency 0."""
    return F.lit(1.0) / (F.lit(K.RARITY_EPS) + F.coalesce(_col(freq), F.lit(0.0)))


def normalise_mode(mode, value=None, label=None) -> Column:
    """normal|anomaly|off from the current or the legacy mode shape."""
    m = F.lower(F.trim(_col(mode)))
    out = F.when(m.isin(K.MODE_NORMAL, K.MODE_ANOMALY, K.MODE_OFF), m)
    if value is not None and label is not None:
        lab = F.lower(F.trim(_col(label)))
        out = out.when(F.coalesce(_col(value), F.lit(False)) & lab.isin(K.MODE_NORMAL, K.MODE_ANOMALY), lab)
    return out.otherwise(F.lit(K.MODE_OFF))


def prediction_to_binary(pred) -> Column:
    return F.when(_col(pred) == K.ANOMALY_PREDICTION, 1).otherwise(0)


def prediction_label(pred) -> Column:
    return F.when(_col(pred) == K.ANOMALY_PREDICTION, K.LABEL_ANOMALY).otherwise(K.LABEL_NORMAL)


def minmax(x, lo, hi) -> Column:
    """(x - min) / (max - min); a zero range gives NULL instead of 0/0."""
    return (_col(x) - _col(lo)) / F.nullif(_col(hi) - _col(lo), F.lit(0))
