"""Column -> Column expressions.  All JVM-side, no Python UDFs."""

from netsleuth.functions.ip import ip_to_int, ipv4_to_int, is_valid_ipv4, canonical_ip, ipv6_halves
from netsleuth.functions.clock import parse_ts, utc_offset, wall_clock_hour, wall_clock_date, is_night
from netsleuth.functions.hashing import event_hash, fallback_event_id, sha_mod, session_id_from_time, session_id_random
from netsleuth.functions.scalar import (coerce_numeric, hour_anomaly_flag, pkt_anomaly_flag, rarity,
                                        normalise_mode, prediction_to_binary, prediction_label, minmax)
