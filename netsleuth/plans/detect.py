"""End-to-end compositions: train/score (M2-M5) and score-then-rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.operators import evaluate as EV
from netsleuth.operators import explore as EX
from netsleuth.operators import features as FT
from netsleuth.operators import iforest as IF
from netsleuth.operators import rules as R
from netsleuth.operators import scaling as SC
from netsleuth.operators import thresholds as TH
from netsleuth.operators.modes import current_mode
from netsleuth.schemas import MODEL_FEATURES
from netsleuth.session import materialize, written


@dataclass
class Detector:
    """Everything scoring needs, fixed at training: scaler, protocol codes and
    forest.  Saved and loaded as a whole, so a later batch, a stream or a single
    record is scaled and coded as the training rows were (Q10b)."""

    scaler: dict
    model: IF.IsolationForestModel
    codes: dict

    def score(self, feature_rows: DataFrame) -> DataFrame:
        """Decision score and prediction of feature rows (P7: missing, NULL and
        NaN inputs count as 0)."""
        scaled = SC.robust_transform(feature_rows, self.scaler)
        cols = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) if c in scaled.columns
                else F.lit(0.0).alias(c) for c in self.model.features]
        rest = [c for c in scaled.columns if c not in self.model.features]
        return self.model.score(scaled.select(*rest, *cols))

    def save(self, spark, path: str) -> None:
        self.model.save(spark, f"{path}/forest")
        rows = [(f, None if c is None else float(c), float(s)) for f, (c, s) in self.scaler.items()]
        spark.createDataFrame(rows, "feature string, center double, scale double").write.mode("overwrite").parquet(f"{path}/scaler")
        spark.createDataFrame(list(self.codes.items()), "proto string, code int").write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark, path: str) -> "Detector":
        scaler = SC.params_dict(spark.read.parquet(f"{path}/scaler"))
        codes = {r[0]: r[1] for r in spark.read.parquet(f"{path}/codes").collect()}       # one row per protocol
        return cls(scaler, IF.IsolationForestModel.load(spark, f"{path}/forest"), codes)


def train(stored: DataFrame, **forest_args) -> tuple[Detector, DataFrame]:
    """Stored events -> (detector, feature table).  The scaler is fitted on all
    rows (as the reference), the forest on the rows labelled normal (P9)."""
    names = stored.select("proto").where("proto is not null").distinct().orderBy("proto").collect()   # protocol names
    codes = {r[0]: i for i, r in enumerate(names)}
    ft = written(FT.features(stored, codes=codes), "features")      # read by the scaler, the forest, the offset and scoring
    scaler = SC.params_dict(SC.robust_fit(ft, MODEL_FEATURES))
    scaled = SC.robust_transform(ft, scaler)
    model = IF.fit(EX.training_rows(scaled), MODEL_FEATURES, **forest_args)
    return Detector(scaler, model, codes), ft


def score_events(stored: DataFrame, detector: Detector, feature_rows: DataFrame | None = None) -> DataFrame:
    """Stored events + decision score and prediction (raw columns kept)."""
    ft = feature_rows if feature_rows is not None else FT.features(stored, codes=detector.codes)
    s = detector.score(ft).select("event_id", "anomaly_score", "prediction")
    return stored.drop("anomaly_score", "prediction").join(s, "event_id", "inner")


def select_threshold(scored: DataFrame, ground_truth: DataFrame | None) -> float:
    """M7 on the labelled rows when available, else the low-tail quantile."""
    if ground_truth is not None:
        j = EV.join_scores(scored.select("event_id", "anomaly_score", "prediction"), ground_truth)
        return float(TH.best_threshold(j).first()["threshold"])
    return float(TH.quantile_threshold(scored, "anomaly_score", K.LOW_TAIL_PERCENTILE))


def score_and_rules(stored: DataFrame, detector: Detector, thr: float,
                    existing_rules: DataFrame | None = None, feature_rows: DataFrame | None = None,
                    scored: DataFrame | None = None) -> dict:
    """Score the stored events (unless ``scored`` is given) and run the
    rule generator on them."""
    if scored is None:
        scored = score_events(stored, detector, feature_rows)
    return R.generate(scored, stored, thr, existing_rules)


def rule_run(stored: DataFrame, ledger: DataFrame, detector: Detector, thr: float, modes: DataFrame | None = None,
             existing_rules: DataFrame | None = None, batch: int | None = None, at=None) -> dict:
    """M10 on tables in hand: the stored events that the ledger lacks (S4; the
    oldest ``batch`` of them if given) are scored with the features they have in
    the whole store, rules generated from them, and ``ledger_rows`` returned for
    K7.  While a training mode is in force there are ``ledger_rows`` only (Q15).
    ``plans.job`` runs the same against stored state and writes the sinks."""
    ids = materialize(EX.unprocessed(stored, ledger, batch).select("event_id"))
    done = {"ledger_rows": EX.mark_processed(ids, at)}
    if modes is not None:
        now = current_mode(modes).first()
        if now is not None and now["mode"] in (K.MODE_NORMAL, K.MODE_ANOMALY):
            return done
    rows = FT.features(stored, codes=detector.codes).join(ids, "event_id", "left_semi")
    scored = materialize(score_events(stored.join(ids, "event_id", "left_semi"), detector, rows))
    run = R.generate(scored, stored, thr, existing_rules)
    return run | {"scored": scored} | done
