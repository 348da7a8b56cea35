"""The scheduled rule job as a whole.

One batch: claim events, add them to the feature state, score them against
their history, write the scores, make rules, publish the rule file, mark the
events as processed.  Every sink is written under the batch's number and can
be written again: a job that is killed anywhere and started again with the
same number takes the same events and leaves each of them in each sink once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.operators import rules as R
from netsleuth.operators.ledger import Ledger
from netsleuth.operators.modes import current_mode
from netsleuth.operators.state import FeatureState, history_stats, serving_features
from netsleuth.plans.detect import Detector
from netsleuth.schemas import MODE_LOG
from netsleuth.session import exists, materialize, written
from netsleuth.sources import artifacts as A
from netsleuth.sources import versions


#: Shares of single batches in the state before they are merged.
COMPACT_AFTER = 100


@dataclass(frozen=True)
class JobPaths:
    """Where the job reads and writes; ``store`` is partitioned by
    ``event_date``.  ``thresholds`` and ``modes`` may be missing."""

    store: str
    state: str
    scores: str
    rules: str
    ledger: str
    thresholds: str | None = None
    modes: str | None = None


def in_training(spark: SparkSession, modes: str | None) -> bool:
    """Whether the newest row of the mode log names a training mode."""
    if not modes or not exists(spark, modes):
        return False
    now = current_mode(spark.read.schema(MODE_LOG).parquet(modes)).first()
    return now is not None and now["mode"] in (K.MODE_NORMAL, K.MODE_ANOMALY)


def _claim(spark: SparkSession, paths: JobPaths, ledger: Ledger, batch: int, size: int | None, fresh: DataFrame | None) -> tuple[DataFrame, bool]:
    """The ids and days of the batch and whether it falls in training mode;
    chosen once and kept, so a second attempt takes the same."""
    def write(target: str) -> None:
        ids = (ledger.pending(size) if fresh is None else fresh).select("event_id", "event_date")
        training = in_training(spark, paths.modes)
        ids.withColumn("training", F.lit(training)).write.mode("overwrite").parquet(f"{target}/ids")
        spark.range(1).select(F.lit(training).alias("training")).write.mode("overwrite").parquet(f"{target}/mode")
    target = versions.publish(spark, f"{paths.ledger}/claims", batch, write)
    return spark.read.parquet(f"{target}/ids").drop("training"), spark.read.parquet(f"{target}/mode").first()["training"]


def run_batch(spark: SparkSession, paths: JobPaths, detector: Detector, batch: int, size: int | None = None, fresh: DataFrame | None = None,
              at=None, port_col: str = "dest_port", step: Callable[[str], None] = lambda name: None) -> dict:
    """Run batch ``batch`` (numbers grow) over the events that the ledger
    lacks, the oldest ``size`` of them if given, or over the events ``fresh``.

    In training mode the events count as history and as processed, but are not
    scored and make no rules.  The threshold is the stored one (S11) or the
    default.  ``step`` is called after each sink."""
    ledger = Ledger(spark, paths.ledger, paths.store)
    ids, training = _claim(spark, paths, ledger, batch, size, fresh)
    days = [str(r["event_date"]) if r["event_date"] is not None else "__HIVE_DEFAULT_PARTITION__"
            for r in ids.select("event_date").distinct().collect()]                       # days of one batch
    # read by each share of the state, the look-backs, the scores and the features
    events = written(ledger.stored(days).join(ids.select("event_id"), "event_id", "left_semi"), "job-events")
    state = FeatureState(spark, paths.state)
    state.add(events, batch)
    step("state")
    if training:
        ledger.mark(ids, batch, at)
        return {"batch": batch, "training": True, "closed": ledger.close(batch)}

    store = spark.read.parquet(paths.store)

    def write_scores(target: str) -> None:
        rows = serving_features(events, store, state, codes=detector.codes, upto=batch)
        scored = detector.score(rows).select("event_id", "anomaly_score", "prediction")
        events.drop("anomaly_score", "prediction").join(scored, "event_id").write.mode("overwrite").parquet(target)
    scored = spark.read.parquet(versions.publish(spark, paths.scores, batch, write_scores))
    step("scores")

    thr = A.read_threshold(spark, paths.thresholds) if paths.thresholds else float(K.ANOMALY_THRESHOLD)
    existing = materialize(R.parse_rule_lines(A.read_rules(spark, paths.rules, below=batch)))
    pol = materialize(R.policy(scored, thr))                                              # the few anomalies
    past = history_stats(state, pol, upto=batch)
    run = R.generate(scored, None, thr, existing, port_col=port_col, policy_rows=pol, history_rows=past)
    A.publish_rules(spark, R.merge_rule_file(existing, run["new_rules"]), paths.rules, batch)
    step("rules")
    ledger.mark(ids, batch, at)
    step("ledger")
    state.compact(after=COMPACT_AFTER)
    return {"batch": batch, "training": False, "threshold": thr, "closed": ledger.close(batch)}


def scores(spark: SparkSession, paths: JobPaths) -> DataFrame:
    """All published scores with their batch."""
    found = [versions.folder(paths.scores, v) for v in versions.published(spark, paths.scores)]
    return spark.read.option("basePath", paths.scores).parquet(*found).withColumnRenamed("version", "batch")


def start_job(spark: SparkSession, paths: JobPaths, detector: Detector, schema, checkpoint: str, every: str = "5 minutes",
              trigger: dict | None = None, port_col: str = "dest_port"):
    """T4: the job over newly stored events, every ``every`` or as a scheduled
    ``availableNow`` run.  The micro-batch number is the batch number, so a
    micro-batch that is run again after a failure writes over its own."""
    stream = spark.readStream.schema(schema).parquet(paths.store)

    def on_batch(df: DataFrame, epoch: int) -> None:
        run_batch(df.sparkSession, paths, detector, epoch, fresh=df, port_col=port_col)
    return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": every})).start())
