"""Stored artefacts: thresholds, rule files, mode log, empty tables
(S6-S8, S10-S13, K2-K6, K8)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.functions.hashing import session_id_random
from netsleuth.schemas import MODE_LOG
from netsleuth.session import exists
from netsleuth.sources import versions


def table_or_empty(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one with ``schema``."""
    if exists(spark, path):
        reader = spark.read.schema(schema).format(fmt)
        return (reader.option("header", True) if fmt == "csv" else reader).load(path)
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", csv: bool = False) -> None:
    """K2-K4: Parquet (optionally also CSV with a header).  The CSV of a whole
    table is made from the Parquet files, so the table is computed once."""
    df.write.mode(mode).parquet(path)
    if csv:
        if mode == "overwrite":
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        df.write.mode(mode).option("header", True).csv(path + "_csv")


def write_thresholds(best: DataFrame, path: str, grid=K.MIN_PRECISION_GRID,
                     min_precision: float = K.MIN_PRECISION_FOR_THRESHOLD) -> None:
    """K5: the threshold report (Parquet), the selected threshold (text) and
    the parameters (JSON: thr_if, min_precision, grid)."""
    best.write.mode("overwrite").parquet(f"{path}/report")
    best.select(F.col("threshold").cast("string").alias("value")).coalesce(1) \
        .write.mode("overwrite").text(f"{path}/selected")
    params = best.select(F.to_json(F.struct(
        F.col("threshold").alias("thr_if"), F.lit(float(min_precision)).alias("min_precision"),
        F.struct(F.lit(float(grid[0])).alias("start"), F.lit(float(grid[1])).alias("end"),
                 F.lit(int(grid[2])).alias("steps")).alias("grid"))).alias("value"))
    params.coalesce(1).write.mode("overwrite").text(f"{path}/params")


def write_misses(samples: DataFrame, path: str) -> None:
    """K9: the worst misses (``fn_fp_samples``), one folder per kind, as Parquet
    and as CSV with a header for reading by eye."""
    for kind in ("fn", "fp"):
        rows = samples.where(F.col("kind") == kind).drop("kind")
        write_table(rows.coalesce(1), f"{path}/{kind}", csv=True)             # a few rows by their definition


def read_threshold(spark: SparkSession, path: str, default: float = K.ANOMALY_THRESHOLD) -> float:
    """thr_if from the JSON parameters, else the selected-threshold
    text, else the default constant."""
    for sub, parse in (("params", lambda v: json.loads(v).get("thr_if")), ("selected", float)):
        p = f"{path}/{sub}"
        if exists(spark, p):
            row = spark.read.text(p).first()
            if row is not None:
                try:
                    v = parse(row[0])
                    if v is not None:
                        return float(v)
                except (ValueError, TypeError):
                    pass
    return float(default)


def read_rule_files(spark: SparkSession, folder: str, pattern: str = "*.rules") -> DataFrame:
    """Every ``*.rules`` file -> ``(file, line_no, value)``.

    Rule files are small configuration files; each is read whole by one task
    so line positions are kept (a rewritten file keeps its order, Q14)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).withColumn("path", F.input_file_name())
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                      F.posexplode(F.split(F.col("value"), "\n")).alias("line_no", "value")) \
              .where(F.trim("value") != "")


def list_rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """S10 listing: files with their rule counts."""
    from netsleuth.operators.rules import inventory
    return inventory(read_rule_files(spark, folder))


def write_rule_file(merged: DataFrame, path: str) -> None:
    """One text file for the sensor, in file order (existing lines in place,
    then new rules).  ``path`` must be new: a rule file is never written over
    while it is read."""
    ordered = merged.orderBy("section", "line_no", "kind", "text")
    ordered.select(F.when(F.col("enabled") | F.col("text").startswith("#"), F.col("text"))
                    .otherwise(F.concat(F.lit("#"), F.col("text"))).alias("value")) \
           .coalesce(1).write.text(path)


def publish_rules(spark: SparkSession, merged: DataFrame, path: str, version: int) -> str:
    """K6: the rule file as a new version below ``path``.  Readers see the
    version before or this one; one that was begun and not published is left
    where it is and written beside."""
    def write(target: str) -> None:
        attempt = f"{target}/attempt-{uuid.uuid4().hex[:12]}"
        write_rule_file(merged, attempt)
        spark.range(1).select(F.lit(attempt.rsplit("/", 1)[1]).alias("value")).coalesce(1).write.mode("overwrite").text(f"{target}/file")
    return versions.publish(spark, path, version, write)


def rule_file(spark: SparkSession, path: str, below: int | None = None) -> str | None:
    """Folder of the newest published rule file (before version ``below``)."""
    version = versions.current(spark, path, below)
    if version is None:
        return None
    target = versions.folder(path, version)
    return f"{target}/{spark.read.text(f'{target}/file').first()[0]}"


def read_rules(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """``(line_no, value)`` of the newest published rule file, or no line."""
    at = rule_file(spark, path, below)
    if at is None:
        return spark.createDataFrame([], "line_no int, value string")
    whole = spark.read.text(at, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "value")).where(F.trim("value") != "")


def append_mode(spark: SparkSession, path: str, mode: str, session_hash: str | None = None,
                at=None, new_session: bool = False) -> str | None:
    """K8: append a mode switch to the mode log; returns the session id.

    A switch to a training mode keeps the log's last session id, so that one
    session gets both classes, unless ``new_session`` asks for another or
    ``session_hash`` names one; the first training switch makes one.  Switching
    off keeps the id for the next training switch.  Of switches at one time the
    one with the greatest id is the last."""
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    if session_hash is None and not new_session and exists(spark, path):
        last = (spark.read.schema(MODE_LOG).parquet(path).where(F.col("session_hash").isNotNull())
                .agg(F.max_by("session_hash", F.struct("effective_from", "session_hash")).alias("s")).first())
        session_hash = last["s"]
    if session_hash is None and mode in (K.MODE_NORMAL, K.MODE_ANOMALY):
        session_hash = spark.range(1).select(session_id_random(F.lit(mode), ts).alias("s")).first()["s"]
    df = spark.range(1).select(ts.alias("effective_from"), F.lit(mode).alias("mode"),
                               F.lit(None).cast("boolean").alias("value"), F.lit(None).cast("string").alias("label"),
                               F.lit(session_hash).cast("string").alias("session_hash"))
    df.write.mode("append").parquet(path)
    return session_hash
