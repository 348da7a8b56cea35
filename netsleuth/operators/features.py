"""Per-event behavioural features.

Every per-source statistic is computed by grouping (partial aggregation, so a
hot source is combined map-side) and joined back; no feature uses an
unbounded ``Window.partitionBy(src_ip)``.  The four per-source statistics
share one base aggregation on ``(src_ip, dest_port, hour)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.clock import hour_of, is_night, micros
from netsleuth.functions.hashing import fallback_event_id
from netsleuth.functions.ip import ip_to_int
from netsleuth.functions.scalar import hour_anomaly_flag, pkt_anomaly_flag, rarity
from netsleuth.operators import sequence
from netsleuth.schemas import FEATURE_DEFAULTS, FEATURE_TABLE_COLUMNS


def with_hour(df: DataFrame, ts_col: str = "timestamp", raw_col: str | None = None,
              tz: str | None = None) -> DataFrame:
    """``hour`` and ``is_night``.  The hour is the wall clock as written when
    the raw text is available, else the hour in ``tz`` (an IANA zone) or UTC;
    unknown -> 0."""
    if raw_col and raw_col in df.columns and tz is None:
        from netsleuth.functions.clock import wall_clock_hour
        h = wall_clock_hour(raw_col)
    elif tz is not None:
        h = F.coalesce(F.hour(F.from_utc_timestamp(F.col(ts_col), tz)), F.lit(0))
    else:
        h = hour_of(ts_col)
    return df.withColumn("hour", h).withColumn("is_night", is_night("hour"))


def source_base(df: DataFrame, src: str = "src_ip", port: str = "dest_port") -> DataFrame:
    """One shuffle of the events: counts per (source, port, hour)."""
    return df.groupBy(src, port, "hour").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("dest_ip").alias("_n_dest"),
        F.sum((F.col("alert_severity") > 0).cast("int")).alias("_n_sev"))


def source_stats(df: DataFrame, src: str = "src_ip", port: str = "dest_port") -> DataFrame:
    """Per source: ports_used (A1), conn_per_ip (A2), port_entropy (A3),
    failed_ratio by severity (A4) and the modal hour (A5, smallest on ties)."""
    return _source_tables(source_base(df, src, port), src, port)


def _source_tables(base: DataFrame, src: str = "src_ip", port: str = "dest_port") -> DataFrame:
    """``source_stats`` from counts per (source, port, hour)."""
    per_port = base.where(F.col(port).isNotNull()).groupBy(src, port).agg(F.sum("_n").alias("_pc"))
    share = F.col("_pc") / F.sum("_pc").over(_by(src))
    entropy = (per_port.withColumn("_p", share)
               .groupBy(src).agg(F.count(port).alias("ports_used"),
                                 (-F.sum(F.col("_p") * F.log(F.col("_p") + F.lit(K.ENTROPY_EPS)))).alias("port_entropy")))
    per_hour = base.groupBy(src, "hour").agg(F.sum("_n").alias("_hc"))
    # most frequent hour, smallest on ties: max of count * 128 + (127 - hour)
    # (hours are 0-99 as written), a fixed-width key that hash-aggregates
    key = F.col("_hc") * F.lit(128) + (F.lit(127) - F.col("hour").cast("long"))
    modal = per_hour.groupBy(src).agg(F.max(key).alias("_k")) \
                    .select(src, (F.lit(127) - F.pmod(F.col("_k"), F.lit(128))).cast("int").alias("modal_hour"))
    totals = base.groupBy(src).agg(
        F.sum("_n_dest").alias("conn_per_ip"),
        (F.sum("_n_sev") / F.sum("_n")).alias("failed_ratio"))
    return (totals.join(entropy, src, "left").join(modal, src, "left")
            .select(src,
                    F.coalesce("ports_used", F.lit(0)).cast("bigint").alias("ports_used"),
                    F.col("conn_per_ip").cast("bigint").alias("conn_per_ip"),
                    F.coalesce("port_entropy", F.lit(0.0)).alias("port_entropy"),
                    F.col("failed_ratio").cast("double").alias("failed_ratio"),
                    "modal_hour"))


def _by(col: str):
    # window over an already aggregated (source, port) table: one row per port
    return Window.partitionBy(col)


def add_source_features(df: DataFrame, src: str = "src_ip") -> DataFrame:
    """Join the per-source statistics back and derive ``hour_anomaly``."""
    stats = source_stats(df, src)
    out = df.join(stats, src, "left")
    return out.withColumn("hour_anomaly", hour_anomaly_flag("hour", "modal_hour"))


def failed_ratio_rolling(df: DataFrame, src: str = "src_ip", ts_col: str = "timestamp",
                         tie_col: str = "event_id", flag_col: str = "tcp_flags_tc",
                         rows: int = K.ROLLING_FLAG_ROWS) -> DataFrame:
    """Share of SYN-only flags (``'S'``) over the last ``rows`` rows of the
    source (row frame, at least one row), ordered by (time, id)."""
    d = df.withColumn("_s", (F.coalesce(F.col(flag_col) == "S", F.lit(False))).cast("long"))
    d = sequence.positions(d, src, ts_col, tie_col, sums=["_s"])
    d = sequence.lookback(d, src, F.col("_pos") - rows, ["_cum__s"])
    n = F.least(F.col("_pos") + 1, F.lit(rows))
    ratio = (F.col("_cum__s") - F.coalesce(F.col("_lag__cum__s"), F.lit(0))) / n
    ratio = F.when(F.col(src).isNotNull(), ratio.cast("double")).otherwise(F.lit(0.0))     # no source, no sequence
    return d.withColumn("failed_ratio_rolling", ratio).drop("_s", "_pos", "_cum__s", "_lag__cum__s")


def conn_velocity(df: DataFrame, src: str = "src_ip", ts_col: str = "timestamp",
                  tie_col: str = "event_id", rows: int = K.VELOCITY_ROWS) -> DataFrame:
    """Mean of the last ``rows`` inter-arrival times (seconds) of the source.

    The differences telescope: the mean over positions (p-rows, p] equals
    (t_p - t_{p-rows}) / rows, and (t_p - t_0) / p while p < rows, so only one
    look-back is needed.  Rows without time, and each source's first row, get 0.
    """
    d = df.withColumn("_us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    # positions below ``rows`` look back to the source's first timed row;
    # rows without time sort first and are skipped by counting timed rows only
    d = d.withColumn("_timed", F.col("_us").isNotNull().cast("long"))
    d = sequence.positions(d, src, ts_col, tie_col, sums=["_timed"])
    first_timed = F.col("_pos") - F.col("_cum__timed") + 1          # position of the first timed row
    back = F.greatest(F.col("_pos") - rows, first_timed)
    d = sequence.lookback(d, src, back, ["_us"])
    n = F.least(F.col("_cum__timed") - 1, F.lit(rows))
    v = F.when(F.col("_us").isNull() | F.col(src).isNull() | (n <= 0), F.lit(0.0)) \
         .otherwise((F.col("_us") - F.col("_lag__us")).cast("double") / n / F.lit(1e6))
    return d.withColumn("conn_velocity", v.cast("double")).drop("_us", "_pos", "_lag__us", "_timed", "_cum__timed")


def conn_5m(df: DataFrame, src: str = "src_ip", ts_col: str = "timestamp",
            seconds: int = K.CONN_WINDOW_SECONDS, out_col: str = "conn_5m", id_col: str = "event_id",
            method: str | None = None) -> DataFrame:
    """Rows of the same source in ``(t - 5 min, t]``; peers with the same
    time all count; rows without time get 0.  Default: the range-partitioned
    method (split inside bursts) when a unique id column exists, else the
    bucketed window (bounded by one source's rows per ten minutes)."""
    if method is None:
        method = "range" if id_col in df.columns else "bucket"
    out = sequence.trailing_count(df, src, ts_col, seconds * 1_000_000, out_col, method=method,
                                  id_col=id_col if method == "range" else None)
    return out.withColumn(out_col, F.when(F.col(src).isNull(), F.lit(0).cast("long")).otherwise(F.col(out_col)))


def proto_stats(df: DataFrame) -> DataFrame:
    """Per protocol mean and sample std of packet length, distinct ports."""
    return df.where(F.col("proto").isNotNull()).groupBy("proto").agg(
        F.avg("packet_length").alias("proto_pkt_mean"),
        F.stddev_samp("packet_length").alias("proto_pkt_std"),
        F.count_distinct("dest_port").alias("proto_ports"))


def add_proto_features(df: DataFrame) -> DataFrame:
    """J1 + F7: join protocol statistics back, flag packet-length outliers."""
    out = df.join(proto_stats(df), "proto", "left")
    return out.withColumn("pkt_anomaly", pkt_anomaly_flag("packet_length", "proto_pkt_mean", "proto_pkt_std"))


def add_rarity(df: DataFrame) -> DataFrame:
    """A7 + J2 + F8: port and destination rarity, 1 / (1e-6 + share)."""
    out = df.join(_freq_table(df, "dest_port", "_f_port"), "dest_port", "left") \
            .join(_freq_table(df, "dest_ip", "_f_ip"), "dest_ip", "left")
    return out.withColumn("port_rarity", rarity("_f_port")).withColumn("ip_rarity", rarity("_f_ip")) \
              .drop("_f_port", "_f_ip")


def proto_codes(df: DataFrame, col: str = "proto", out_col: str = "proto_code") -> DataFrame:
    """Sorted distinct values -> 0..n-1, NULL -> -1.

    The code table has one row per distinct protocol; it is ranked once and
    joined back (the optimizer broadcasts it by its runtime size)."""
    out = df.join(_proto_code_table(df, col, out_col), col, "left")
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(-1)))


def code_of(col: str, codes: dict[str, int]) -> F.Column:
    """Protocol code by a fixed table; protocols it does not know are -1."""
    if not codes:
        return F.lit(-1)
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(table[F.col(col)], F.lit(-1))


def label_value(df: DataFrame) -> DataFrame:
    """``anomaly``: 1/0 for labelled training rows, -1 otherwise."""
    lab = F.col("training_label")
    training = F.coalesce(F.col("training_mode"), F.lit(False))
    return df.withColumn("anomaly", F.when(training & (lab == K.LABEL_ANOMALY), 1)
                         .when(training & (lab == K.LABEL_NORMAL), 0).otherwise(-1))


def ensure_columns(df: DataFrame, defaults: dict = FEATURE_DEFAULTS) -> DataFrame:
    """Add any missing column with its default."""
    out = df
    for c, v in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return out


def ordered_features(df: DataFrame, src: str = "src_ip", ts_col: str = "timestamp", tie_col: str = "event_id",
                     flag_col: str | None = None) -> DataFrame:
    """W2 and W3, and W1 if ``flag_col`` is given, from one ranked pass:
    ``(src, _x, tie, conn_5m, conn_velocity[, failed_ratio_rolling])``, one row
    per distinct (source, time, tie).  Rows without a source have no sequence
    of their own and get 0; rows without time count for W1 only."""
    d = df.select(src, ts_col, tie_col, F.col(ts_col).isNotNull().cast("long").alias("_timed"),
                  *([F.coalesce(F.col(flag_col) == "S", F.lit(False)).cast("long").alias("_s")] if flag_col else []))
    sums = ["_timed"] + (["_s"] if flag_col else [])
    d = sequence.ordered_counts(d, src, ts_col, tie_col, K.CONN_WINDOW_SECONDS * 1_000_000, sums=sums)
    k = K.VELOCITY_ROWS
    first_timed = F.col("_pos") - F.col("_cum__timed") + 1
    d = sequence.lookback(d, src, F.greatest(F.col("_pos") - k, first_timed), ["_x"])
    n = F.least(F.col("_cum__timed") - 1, F.lit(k))
    velocity = F.when(F.col("_x").isNull() | (n <= 0), F.lit(0.0)).otherwise((F.col("_x") - F.col("_lag__x")).cast("double") / n / F.lit(1e6))
    owned = F.col(src).isNotNull()
    out = [F.max(F.when(owned, F.col("_in_width")).otherwise(F.lit(0))).cast("long").alias("conn_5m"),
           F.max(F.when(owned, velocity).otherwise(F.lit(0.0))).alias("conn_velocity")]
    if flag_col:
        r = K.ROLLING_FLAG_ROWS
        d = sequence.lookback(d, src, F.col("_pos") - r, ["_cum__s"])
        ratio = (F.col("_cum__s") - F.coalesce(F.col("_lag__cum__s"), F.lit(0))) / F.least(F.col("_pos") + 1, F.lit(r))
        out.append(F.max(F.when(owned, ratio.cast("double")).otherwise(F.lit(0.0))).alias("failed_ratio_rolling"))
    return d.groupBy(src, "_x", tie_col).agg(*out)


def _all_stats(base: DataFrame) -> dict[str, DataFrame]:
    """Every grouped statistic the features join back.  Source, port, protocol
    code and port-count tables come from one aggregation of the events on
    (source, port, hour, protocol); packet lengths and destinations have one
    aggregation each."""
    cells = base.groupBy("src_ip", "dest_port", "hour", "proto").agg(
        F.count(F.lit(1)).alias("_n"), F.count("dest_ip").alias("_n_dest"),
        F.sum((F.col("alert_severity") > 0).cast("int")).alias("_n_sev"))
    by_src = cells.groupBy("src_ip", "dest_port", "hour").agg(*[F.sum(c).alias(c) for c in ("_n", "_n_dest", "_n_sev")])
    proto = (base.where(F.col("proto").isNotNull()).groupBy("proto")
             .agg(F.avg("packet_length").alias("proto_pkt_mean"), F.stddev_samp("packet_length").alias("proto_pkt_std")))
    dest = base.where(F.col("dest_ip").isNotNull()).groupBy("dest_ip").agg(F.count(F.lit(1)).alias("_c"))
    return joined_stats(by_src, cells, proto, dest, dest.agg(F.sum("_c")).scalar())


def joined_stats(by_src: DataFrame, cells: DataFrame, proto: DataFrame, dest: DataFrame, n_dest) -> dict[str, DataFrame]:
    """The tables that ``features`` joins back, by key, from counts: ``by_src``
    per (source, port, hour), ``cells`` with protocol, port and ``_n``, ``proto``
    with the packet statistics, ``dest`` with ``_c`` of ``n_dest`` events."""
    ports = cells.where(F.col("proto").isNotNull()).groupBy("proto").agg(F.count_distinct("dest_port").alias("proto_ports"))
    w = Window.orderBy("proto")                                                     # one row per protocol
    protocols = (ports.join(proto, "proto")
                 .withColumn("proto_code", (F.dense_rank().over(w) - 1).cast("int")))
    port = cells.where(F.col("dest_port").isNotNull()).groupBy("dest_port").agg(F.sum("_n").alias("_c"))
    share = lambda t, key, name, n: t.select(key, (F.col("_c") / n).alias(name))
    return {"src_ip": _source_tables(by_src), "proto": protocols, "dest_port": share(port, "dest_port", "_f_port", port.agg(F.sum("_c")).scalar()),
            "dest_ip": share(dest, "dest_ip", "_f_ip", n_dest)}


def event_base(df: DataFrame, raw_ts_col: str | None = None) -> DataFrame:
    """Events with the columns that features are counted from: defaults for
    missing ones, an id, the hour."""
    d = ensure_columns(df, {"alert_severity": 0, "packet_length": 0, "dest_port": 0,
                            "src_port": 0, "dest_ip": "0.0.0.0", "src_ip": "0.0.0.0"})
    raw = raw_ts_col or ("timestamp_raw" if "timestamp_raw" in d.columns else None)
    if "event_id" not in d.columns:
        d = d.withColumn("event_id", fallback_event_id("src_ip", "dest_ip", raw or F.col("timestamp")))
    return with_hour(d, raw_col=raw)


def features(df: DataFrame, raw_ts_col: str | None = None, failed_by_flags: bool = False,
             keep: tuple = ("training_label",), codes: dict[str, int] | None = None,
             stats: dict[str, DataFrame] | None = None, context: DataFrame | None = None) -> DataFrame:
    """Stored events -> the 24-column feature table (P5), plus ``keep`` columns.

    ``src_ip``/``dest_ip`` become numbers (F1), ``proto`` its code (W4); the
    label column is carried beside the features (never one of them).  The hour
    is the wall clock as written when the events have ``timestamp_raw`` (or the
    column named), else UTC.  ``failed_by_flags`` takes the flag-based failed
    ratio (W1) instead of the severity-based one (A4).  Events without id get
    the fallback id (F12); rows without a source stay, with 0 in what is
    counted per source.  ``codes`` are protocol codes fixed at training; without
    them the protocols of ``df`` are ranked.  ``stats`` (``joined_stats``) and
    ``context`` (the rows of ``df`` and those before them: source, time, id)
    take the place of what is counted over ``df``, so a batch can be measured
    against its history.

    Plan: every grouped statistic is joined back in one chain (AQE broadcasts
    the small ones and splits hot keys); the ordered features come from one
    ranked pass over (source, time, id) and are joined back once.
    """
    base = event_base(df, raw_ts_col)
    ordered = ordered_features(base if context is None else context, flag_col="tcp_flags_tc" if failed_by_flags else None)
    out = base
    for key, table in (_all_stats(base) if stats is None else stats).items():
        out = out.join(table, key, "left")
    names = ["conn_5m", "conn_velocity"] + ["failed_ratio_rolling"] * failed_by_flags
    found = ordered.select(F.col("src_ip").alias("_os"), F.col("_x").alias("_ox"), F.col("event_id").alias("_oe"), *names)
    out = out.withColumn("_x", micros("timestamp"))
    same = (out["event_id"].eqNullSafe(found["_oe"]) & out["src_ip"].eqNullSafe(found["_os"]) & out["_x"].eqNullSafe(found["_ox"]))
    out = out.join(found, same, "left").drop("_os", "_ox", "_oe", "_x")
    out = (out.withColumn("hour_anomaly", hour_anomaly_flag("hour", "modal_hour"))
              .withColumn("pkt_anomaly", pkt_anomaly_flag("packet_length", "proto_pkt_mean", "proto_pkt_std"))
              .withColumn("proto_code", F.coalesce(F.col("proto_code"), F.lit(-1)) if codes is None else code_of("proto", codes))
              .withColumn("port_rarity", rarity("_f_port")).withColumn("ip_rarity", rarity("_f_ip")))
    for c in ("ports_used", "conn_per_ip", "port_entropy", "failed_ratio"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)))
    if failed_by_flags:
        out = out.withColumn("failed_ratio", F.col("failed_ratio_rolling"))
    out = label_value(out) if "training_label" in out.columns else out
    out = ensure_columns(out)
    out_cols = []
    for c in FEATURE_TABLE_COLUMNS:
        if c in ("src_ip", "dest_ip"):
            out_cols.append(ip_to_int(c).alias(c))
        elif c == "proto":
            out_cols.append(F.col("proto_code").alias("proto"))
        elif c == "event_id":
            out_cols.append(F.col("event_id").cast("string").alias("event_id"))
        else:
            out_cols.append(F.col(c))
    extra = [F.col(c) for c in keep if c in out.columns]
    return out.select(*out_cols, *extra)


def _proto_code_table(df: DataFrame, col: str = "proto", out_col: str = "proto_code") -> DataFrame:
    # ranked over the distinct protocol names only (a handful of rows)
    return df.select(col).where(F.col(col).isNotNull()).distinct() \
             .withColumn(out_col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int"))


def _freq_table(df: DataFrame, col: str, name: str) -> DataFrame:
    total = df.select(F.count(col)).scalar()
    return df.where(F.col(col).isNotNull()).groupBy(col).agg((F.count(F.lit(1)) / total).alias(name))
