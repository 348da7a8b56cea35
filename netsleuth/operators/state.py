"""Mergeable state for serving features against history (M9, M10, A1-A7, A10,
J6, W1-W3).

A batch's features depend on everything stored so far, not on the batch alone.
Re-reading the store for each batch would cost the whole history every five
minutes, so what features need is kept as tables of counts that merge by
addition.  A batch adds its own share once, under its number; a retried batch
writes the same share over.  Readers add up the shares up to a version.

``sources``   per (source, port, hour): events, with a destination, with severity
``ports``     per (protocol, port): events
``protos``    per protocol: events, sum and sum of squares of packet lengths
``dests``     per destination: events;  ``totals``: events with a destination
``history``   per source: events, least and greatest port
``tails``     per (source, hour of the clock): the last events, for look-backs
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.clock import micros
from netsleuth.operators import features as FT
from netsleuth.sources import versions

#: Events of a tail: the longest look-back of any ordered feature.
TAIL_ROWS = max(K.VELOCITY_ROWS + 1, K.ROLLING_FLAG_ROWS)
SLOT_MICROS = 3600 * 1_000_000
TABLES = ("sources", "ports", "protos", "dests", "totals", "history", "tails")

_KEYS = {"sources": ["src_ip", "dest_port", "hour"], "ports": ["proto", "dest_port"], "protos": ["proto"], "dests": ["dest_ip"], "totals": [],
         "history": ["src_ip"]}
_SUMS = {"sources": ["_n", "_n_dest", "_n_sev"], "ports": ["_n"], "protos": ["_n", "_s", "_ss"], "dests": ["_c"], "totals": ["_n_dest"],
         "history": ["n_hist"]}
_NARROW = ["src_ip", "timestamp", "event_id", "tcp_flags_tc"]


def _slot(ts_col: str = "timestamp"):
    return F.floor(micros(ts_col) / F.lit(SLOT_MICROS)).cast("long")


def _narrow(events: DataFrame) -> DataFrame:
    d = events if "tcp_flags_tc" in events.columns else events.withColumn("tcp_flags_tc", F.lit(None).cast("string"))
    return d.select(*_NARROW)


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The last ``TAIL_ROWS`` rows of each key by (time, id); a ranking limit,
    so each task passes on that many rows of a hot source."""
    w = Window.partitionBy(*keys).orderBy(F.col("timestamp").desc(), F.col("event_id").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= TAIL_ROWS).drop("_r")


def shares(events: DataFrame) -> dict[str, DataFrame]:
    """The share of each table that a batch of events adds."""
    b = FT.event_base(events)
    length = F.col("packet_length").cast("decimal(20,0)")
    cells = b.groupBy("src_ip", "dest_port", "hour").agg(
        F.count(F.lit(1)).alias("_n"), F.count("dest_ip").alias("_n_dest"), F.sum((F.col("alert_severity") > 0).cast("long")).alias("_n_sev"))
    dests = b.where(F.col("dest_ip").isNotNull()).groupBy("dest_ip").agg(F.count(F.lit(1)).alias("_c"))
    return {
        "sources": cells,
        "ports": b.groupBy("proto", "dest_port").agg(F.count(F.lit(1)).alias("_n")),
        "protos": b.where(F.col("proto").isNotNull()).groupBy("proto").agg(
            F.count("packet_length").alias("_n"), F.sum(length).cast("decimal(38,0)").alias("_s"),
            F.sum((length * length).cast("decimal(28,0)")).cast("decimal(38,0)").alias("_ss")),
        "dests": dests,
        "totals": b.agg(F.count("dest_ip").alias("_n_dest")),
        "history": b.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n_hist"), F.min("dest_port").alias("port_min"),
                                           F.max("dest_port").alias("port_max")),
        "tails": _last(_narrow(b).where(F.col("src_ip").isNotNull() & F.col("timestamp").isNotNull())
                       .withColumn("slot", _slot()), "src_ip", "slot"),
    }


def merge(name: str, rows: DataFrame) -> DataFrame:
    """One table from the shares in ``rows``."""
    if name == "tails":
        return _last(rows, "src_ip", "slot")
    aggs = [F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in _SUMS[name]]
    if name == "history":
        aggs += [F.min("port_min").alias("port_min"), F.max("port_max").alias("port_max")]
    return rows.groupBy(*_KEYS[name]).agg(*aggs) if _KEYS[name] else rows.agg(*aggs)


class FeatureState:
    """State tables below ``path``; batch numbers grow."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int | None:
        return versions.current(self.spark, self.path)

    def add(self, events: DataFrame, batch: int) -> None:
        """Add a batch once: its shares, then the pointer that makes them
        count.  A batch that is in already stays."""
        def write(target: str) -> None:
            for name, share in shares(events).items():
                share.write.mode("overwrite").parquet(f"{target}/{name}")
        versions.publish(self.spark, self.path, batch, write)

    def rows(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The shares of a table up to a version, from the newest compacted
        one on; None if there is none."""
        upto = self.version() if upto is None else upto
        found = [v for v in versions.published(self.spark, self.path) if upto is not None and v <= upto]
        if not found:
            return None
        base = versions.current(self.spark, f"{self.path}/compact", below=upto + 1)
        folders = [f"{versions.folder(self.path, v)}/{name}" for v in found if base is None or v > base]
        if base is not None:
            folders.append(f"{versions.folder(self.path + '/compact', base)}/{name}")
        return self.spark.read.parquet(*folders)

    def table(self, name: str, upto: int | None = None) -> DataFrame | None:
        rows = self.rows(name, upto)
        return None if rows is None else merge(name, rows)

    def compact(self, after: int = 1) -> None:
        """Merge all shares into one table each, if there are ``after`` or more
        since the last time; readers of older versions still find theirs."""
        version = self.version()
        base = versions.current(self.spark, f"{self.path}/compact")
        fresh = [v for v in versions.published(self.spark, self.path) if base is None or v > base]
        if version is not None and len(fresh) >= after:
            def write(target: str) -> None:
                for name in TABLES:
                    self.table(name, version).write.mode("overwrite").parquet(f"{target}/{name}")
            versions.publish(self.spark, f"{self.path}/compact", version, write)


def history_stats(state: FeatureState, sources: DataFrame, min_events: int = K.CONTEXT_MIN_EVENTS, upto: int | None = None) -> DataFrame:
    """A10 + J6 from the state: rows and port range of the given sources, for
    those with more than ``min_events``."""
    wanted = sources.select("src_ip").distinct()
    return merge("history", state.rows("history", upto).join(wanted, "src_ip", "left_semi")).where(F.col("n_hist") > min_events)


def ordered_context(batch: DataFrame, store: DataFrame, state: FeatureState, upto: int | None = None) -> DataFrame:
    """The rows that the ordered features of ``batch`` look at: the batch, the
    stored events since the hour in which its earliest look-back window begins,
    and the sources' last events before that hour."""
    first = batch.agg((F.min(micros("timestamp")) - K.CONN_WINDOW_SECONDS * 1_000_000).alias("x")).first()["x"]
    rows = _narrow(batch)
    if first is None:
        return rows
    slot = first // SLOT_MICROS
    start = F.timestamp_micros(F.lit(slot * SLOT_MICROS))
    recent = store.where((F.col("timestamp") >= start) | F.col("timestamp").isNull())
    if "event_date" in store.columns:                    # prunes the partitions before
        recent = recent.where((F.col("event_date") >= F.to_date(start)) | F.col("event_date").isNull())
    sources = batch.select("src_ip").distinct()
    before = state.rows("tails", upto)
    older = _last(before.where(F.col("slot") < slot).join(sources, "src_ip", "left_semi").select(*_NARROW), "src_ip")
    stored = _narrow(recent).join(sources, "src_ip", "left_semi").join(batch.select("event_id"), "event_id", "left_anti")
    return rows.unionByName(stored).unionByName(older)


def serving_features(batch: DataFrame, store: DataFrame, state: FeatureState, codes: dict[str, int] | None = None,
                     upto: int | None = None, **args) -> DataFrame:
    """The feature table of ``batch`` as of the state at version ``upto`` (the
    newest), which has the batch in it: equal to the rows that ``features`` would
    give for it over all events of the state.

    ``store``: stored events, of which those since the hour before the batch
    are read.  State tables are cut to the batch's sources and destinations
    before they are added up."""
    upto = state.version() if upto is None else upto
    base = FT.event_base(batch)

    def cut(name: str, key: str) -> DataFrame:
        return merge(name, state.rows(name, upto).join(base.select(key).distinct(), key, "left_semi"))
    n, s, ss = (F.col(c).cast("decimal(38,0)") for c in ("_n", "_s", "_ss"))
    spread = (n * ss - s * s).cast("double") / (F.col("_n") * (F.col("_n") - 1)).cast("double")
    protos = state.table("protos", upto).select("proto", F.try_divide(F.col("_s").cast("double"), "_n").alias("proto_pkt_mean"),
                                                F.when(F.col("_n") > 1, F.sqrt(spread)).alias("proto_pkt_std"))
    stats = FT.joined_stats(cut("sources", "src_ip"), state.table("ports", upto), protos, cut("dests", "dest_ip"),
                            state.table("totals", upto).select("_n_dest").scalar())
    return FT.features(batch, codes=codes, stats=stats, context=ordered_context(base, store, state, upto), **args)
