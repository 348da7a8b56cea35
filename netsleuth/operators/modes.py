"""Operating mode: normalisation (F9), session ids (F10) and the as-of lookup
of the mode in force at each event's time (J9).

The mode log is append-only ``(effective_from, mode, value, label,
session_hash)``; the current mode is its latest row.  Events are labelled with
the mode in force *at their own timestamp*, so a replayed log gets the labels
it had when it was captured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.clock import micros
from netsleuth.functions.hashing import session_id_from_time
from netsleuth.functions.scalar import normalise_mode

# Steps of the look-up: whole seconds, minutes and hours.
SECOND, MINUTE, HOUR = 1_000_000, 60 * 1_000_000, 3600 * 1_000_000
# Switches, and hours between the first and the last, up to which the look-up tables are broadcast.
BROADCAST_SWITCHES = 200_000


def normalise_log(modes: DataFrame) -> DataFrame:
    """-> ``(effective_from, mode, session)`` with normalised mode text and a
    session id for every training row (explicit one, else time-derived)."""
    cols = modes.columns
    value = F.col("value") if "value" in cols else None
    lab = F.col("label") if "label" in cols else None
    mode = normalise_mode(F.col("mode"), value, lab)
    explicit = F.col("session_hash") if "session_hash" in cols else F.lit(None).cast("string")
    session = F.when(mode.isin(K.MODE_NORMAL, K.MODE_ANOMALY),
                     F.coalesce(explicit, session_id_from_time(mode, F.col("effective_from"))))
    return modes.where(F.col("effective_from").isNotNull()).select(
        "effective_from", mode.alias("mode"), session.alias("session"))


def current_mode(modes: DataFrame) -> DataFrame:
    """Latest mode row (one row), of equal times the greatest (mode, session)."""
    n = normalise_log(modes)
    return n.agg(F.max(F.struct("effective_from", "mode", "session")).alias("m")) \
            .select("m.mode", "m.session", "m.effective_from")


def mode_steps(modes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Look-up tables of a mode log, each switch in each of them once at most,
    and a row of facts about the log.

    ``(_sec, _in_sec)``: the switches of a second; ``(_min, _in_min)``: the last
    switch of each second of a minute; ``(_hour, _in_hour, _before)``: the last
    switch of each minute of an hour, and the one before the hour, for every hour
    from the first switch to the last.  Switches are ``(k, m)`` in order."""
    md = (normalise_log(modes).select(micros("effective_from").alias("_t"), F.struct("mode", "session").alias("_m"))
          .groupBy("_t").agg(F.max("_m").alias("_m")))
    step = lambda unit: F.floor(F.col("_t") / F.lit(unit)).cast("long")

    def steps(unit: int, inner, key: str, name: str) -> DataFrame:
        last = md.groupBy(step(unit).alias(key), inner.alias("k")).agg(F.max_by("_m", "_t").alias("m"))
        return last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias(name))
    facts = md.agg(F.count(F.lit(1)).alias("n"), F.min(step(HOUR)).alias("first"), F.max(step(HOUR)).alias("last"),
                   F.max_by("_m", "_t").alias("final")).first().asDict()
    hours = steps(HOUR, step(MINUTE), "_hour", "_in_hour")
    if facts["n"]:
        every = md.sparkSession.range(facts["first"], facts["last"] + 1).withColumnRenamed("id", "_hour").join(hours, "_hour", "left")
        w = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)          # one row per hour
        hours = every.withColumn("_before", F.last(F.element_at("_in_hour", -1)["m"], ignorenulls=True).over(w))
    return steps(SECOND, F.col("_t"), "_sec", "_in_sec"), steps(MINUTE, step(SECOND), "_min", "_in_min"), hours, facts


def attach_mode(events: DataFrame, modes: DataFrame, ts_col: str = "timestamp", broadcast_switches: int = BROADCAST_SWITCHES) -> DataFrame:
    """Add ``mode`` and ``session`` in force at each event's time.

    Of mode rows with the same time the greatest (mode, session) counts; a row
    is in force from its own instant on; events before the first row or without
    time are ``off``.  An event looks among the switches of its own second, then
    the earlier seconds of its minute, the earlier minutes of its hour, then what
    was in force before the hour: three equi-joins to tables that have one row per
    second or minute with a switch and one per hour of the log.  They are broadcast if
    the log is small enough, so events are not shuffled; else they are joined by
    shuffle, where a flooded second is split like any hot key against one row."""
    seconds, minutes, hours, facts = mode_steps(modes)
    off = [F.lit(K.MODE_OFF).alias("mode"), F.lit(None).cast("string").alias("session")]
    if not facts["n"]:
        return events.select(*events.columns, *off)
    if max(facts["n"], facts["last"] - facts["first"]) <= broadcast_switches:
        seconds, minutes, hours = F.broadcast(seconds), F.broadcast(minutes), F.broadcast(hours)
    step = lambda unit: F.floor(F.col("_t") / F.lit(unit)).cast("long")
    d = events.withColumn("_t", micros(ts_col)).withColumn("_sec", step(SECOND)).withColumn("_min", step(MINUTE)).withColumn("_hour", step(HOUR))
    d = d.join(seconds, "_sec", "left").join(minutes, "_min", "left").join(hours, "_hour", "left")

    def last(name: str, upto) -> F.Column:
        return F.try_element_at(F.filter(name, upto), F.lit(-1))["m"]
    final = F.struct(F.lit(facts["final"]["mode"]).cast("string").alias("mode"), F.lit(facts["final"]["session"]).cast("string").alias("session"))
    found = F.coalesce(last("_in_sec", lambda x: x["k"] <= F.col("_t")), last("_in_min", lambda x: x["k"] < F.col("_sec")),
                       last("_in_hour", lambda x: x["k"] < F.col("_min")), F.col("_before"), F.when(F.col("_hour") > facts["last"], final))
    d = d.withColumn("_found", found)
    return d.select(*events.columns, F.coalesce(F.col("_found")["mode"], F.lit(K.MODE_OFF)).alias("mode"), F.col("_found")["session"].alias("session"))
