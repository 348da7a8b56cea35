"""Isolation Forest built and applied on Spark.

Fit
  1. sampling in one scan, independent of partitioning: for every row and
     tree, ``u = xxhash64(id, seed, tree)`` mapped to [0, 1); rows with
     ``u < 2 * psi / n`` are emitted for that tree (about 2 * psi rows per tree,
     whatever the table size), and each tree keeps its ``psi`` smallest ``u``
     — a uniform sample without replacement per tree, as in Liu et al.;
  2. ``groupBy(tree).applyInPandas(build)``: one task per tree sees at most
     2 * psi rows; random split feature among the non-constant ones, uniform
     threshold, height limit ceil(log2 psi), numpy RNG seeded by (seed, tree);
  3. the model is the node table (at most trees * (2 * psi - 1) rows, fixed by
     the parameters, not by the data) — collected once and broadcast;
  4. ``offset`` = the ``contamination`` quantile of the training rows'
     ``-s`` (a Spark aggregate), so that ``decision = -s - offset`` is negative
     for about ``contamination`` of the training rows.
Score
  an Arrow pandas UDF walks all trees level by level in numpy per batch:
  ``s = 2 ** (-E[h] / c(psi))``, ``anomaly_score = -s - offset`` (higher =
  more normal), ``prediction = -1`` when the score is negative.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth import constants as K
from netsleuth.operators.scaling import quantiles
from netsleuth.schemas import ISOLATION_NODE

EULER_GAMMA = 0.5772156649015329
OVERSAMPLE = 2.0


def average_path_length(n):
    """c(n): average unsuccessful-search path length of a BST with n nodes."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(tree_id: int, X: np.ndarray, height_limit: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree_id])
    nodes: list[list] = []
    stack = [(np.arange(X.shape[0]), 0, -1, 0)]   # rows, depth, parent, side
    while stack:
        rows, depth, parent, side = stack.pop()
        nid = len(nodes)
        nodes.append([tree_id, nid, -1, 0.0, -1, -1, int(rows.size), depth])
        if parent >= 0:
            nodes[parent][4 if side == 0 else 5] = nid
        if depth >= height_limit or rows.size <= 1:
            continue
        sub = X[rows]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(usable[rng.integers(usable.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        left = rows[sub[:, f] <= thr]
        right = rows[sub[:, f] > thr]
        nodes[nid][2], nodes[nid][3] = f, thr
        stack.append((right, depth + 1, nid, 1))
        stack.append((left, depth + 1, nid, 0))
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForestModel:
    features: list[str]
    n_trees: int
    psi: int
    contamination: float
    seed: int
    nodes: pd.DataFrame
    offset: float = 0.0
    _arrays: dict = field(default=None, repr=False)

    # --- arrays for vectorised traversal -------------------------------
    def arrays(self) -> dict:
        if self._arrays is None:
            nd = self.nodes
            T = self.n_trees
            M = int(nd.groupby("tree_id").size().max()) if len(nd) else 1
            feat = np.full((T, M), -1, dtype=np.int32)
            thr = np.zeros((T, M))
            left = np.zeros((T, M), dtype=np.int32)
            right = np.zeros((T, M), dtype=np.int32)
            leaf_len = np.zeros((T, M))
            t, n = nd["tree_id"].to_numpy(), nd["node_id"].to_numpy()
            feat[t, n] = nd["feature"].to_numpy()
            thr[t, n] = nd["threshold"].to_numpy()
            left[t, n] = nd["left"].to_numpy()
            right[t, n] = nd["right"].to_numpy()
            leaf_len[t, n] = nd["depth"].to_numpy() + average_path_length(nd["size"].to_numpy())
            self._arrays = {"feat": feat, "thr": thr, "left": left, "right": right, "leaf": leaf_len,
                            "depth": int(nd["depth"].max()) if len(nd) else 0,
                            "c_psi": float(average_path_length([self.psi])[0])}
        return self._arrays

    # --- scoring --------------------------------------------------------
    @staticmethod
    def raw_scores(X: np.ndarray, a: dict) -> np.ndarray:
        """s = 2 ** (-E[h(x)] / c(psi)) for every row of X."""
        T = a["feat"].shape[0]
        n = X.shape[0]
        idx = np.zeros((T, n), dtype=np.int32)
        tix = np.arange(T)[:, None]
        for _ in range(a["depth"] + 1):
            f = a["feat"][tix, idx]
            internal = f >= 0
            if not internal.any():
                break
            xv = X[np.arange(n)[None, :], np.where(internal, f, 0)]
            go_left = xv <= a["thr"][tix, idx]
            nxt = np.where(go_left, a["left"][tix, idx], a["right"][tix, idx])
            idx = np.where(internal, nxt, idx)
        h = a["leaf"][tix, idx].mean(axis=0)
        c = a["c_psi"] if a["c_psi"] > 0 else 1.0
        return np.power(2.0, -h / c)

    def score_column(self, spark: SparkSession):
        """A pandas UDF (feature columns -> anomaly_score) with the model arrays
        broadcast once."""
        bc = spark.sparkContext.broadcast(self.arrays())
        offset = float(self.offset)

        @F.pandas_udf("double")
        def _score(*cols: pd.Series) -> pd.Series:
            X = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in cols]), nan=0.0)
            return pd.Series(-IsolationForestModel.raw_scores(X, bc.value) - offset)

        return _score

    def score(self, df: DataFrame, score_col: str = "anomaly_score", pred_col: str = "prediction") -> DataFrame:
        """M3 + M4 (+ M9 for any batch or stream): decision score and -1/1."""
        udf = self.score_column(df.sparkSession)
        cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features]
        out = df.withColumn(score_col, udf(*cols))
        return out.withColumn(pred_col, F.when(F.col(score_col) < 0, K.ANOMALY_PREDICTION)
                              .otherwise(K.NORMAL_PREDICTION))

    # --- persistence (K10) ----------------------------------------------
    def params(self) -> dict:
        return {"features": self.features, "n_trees": self.n_trees, "psi": self.psi,
                "contamination": self.contamination, "seed": self.seed, "offset": self.offset}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, ISOLATION_NODE).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(self.params()),)], "params string") \
             .write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForestModel":
        p = json.loads(spark.read.json(f"{path}/params").first()["params"])
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes=nodes, **{k: p[k] for k in ("features", "n_trees", "psi", "contamination", "seed",
                                                       "offset")})


def sample_for_trees(df: DataFrame, features: list[str], n: int, n_trees: int, psi: int, seed: int,
                     id_col: str) -> DataFrame:
    """Rows per tree: ``(tree, u, _id, x_0..x_k)``, at most ``psi`` per tree.

    Every row draws one hash per tree; those under the rate ``2 * psi / n`` are
    candidates (about ``2 * psi`` per tree, whatever the table size) and each
    tree keeps its ``psi`` smallest: independent uniform samples, drawn the
    same way at every size."""
    scale = float(2 ** 53)
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    xcols = [f"x{i}" for i in range(len(features))]
    ident = F.col(id_col).cast("string")
    rate = min(1.0, OVERSAMPLE * psi / n)
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    picks = F.filter(
        F.transform(trees, lambda t: F.struct(
            t.alias("tree"),
            (F.pmod(F.xxhash64(ident, F.lit(seed), t), F.lit(2 ** 53)) / F.lit(scale)).alias("u"))),
        lambda s: s["u"] < F.lit(rate))
    picked = df.select(ident.alias("_id"), *xs, F.explode(picks).alias("p")).select("p.tree", "p.u", "_id", *xcols)
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("u", "_id")          # about 2 * psi rows per tree
    return picked.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi).drop("_rk")


def fit(df: DataFrame, features: list[str], n_trees: int = K.IFOREST_TREES,
        max_samples: int = K.IFOREST_MAX_SAMPLES, contamination: float = K.IFOREST_CONTAMINATION,
        seed: int = K.IFOREST_SEED, id_col: str = "event_id") -> IsolationForestModel:
    """M2: fit on ``df`` (typically the rows labelled normal)."""
    n = df.count()
    if n == 0:
        raise ValueError("no training rows")
    psi = int(min(max_samples, n))
    height = int(math.ceil(math.log2(max(psi, 2))))
    k = len(features)
    sampled = sample_for_trees(df, features, n, n_trees, psi, seed, id_col)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "_id"], kind="mergesort")
        X = pdf[[f"x{i}" for i in range(k)]].to_numpy(dtype=float)
        rows = _build_tree(int(pdf["tree"].iloc[0]), X, height, seed)
        return pd.DataFrame(rows, columns=[f.name for f in ISOLATION_NODE.fields])

    nodes = sampled.groupBy("tree").applyInPandas(build, ISOLATION_NODE).toPandas()
    nodes = nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    model = IsolationForestModel(features=list(features), n_trees=n_trees, psi=psi,
                                 contamination=contamination, seed=seed, nodes=nodes)
    if contamination is not None and contamination > 0:
        scored = model.score(df.select(*features), score_col="_d")
        # decision = -s - offset with offset 0 so far: the exact quantile of -s
        model.offset = float(quantiles(scored, ["_d"], [contamination])["_d"][0])
    return model
