"""Scaling (M1, F21).

Fitting collects a handful of numbers per column to the driver (three
quantiles, or min and max); transforming is plain column arithmetic.  The
fitted parameters are a small table so that training and serving apply the
same transformation (Q10b).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.operators.sequence import positions


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], weight: str | None = None) -> dict:
    """``{col: [q(p) for p in probs]}``: exact, linearly interpolated, at every
    size (as numpy's default and SQL's ``percentile_cont``).  A row counts
    ``weight`` times if that column is named.

    Equal values are counted first; running counts over the (column, value)
    order come from range chunks, which split a column over tasks; the two rows
    around each wanted rank are then picked by one aggregation.  Only those
    values come to the driver."""
    ps, cols = [float(p) for p in probs], list(cols)
    names = {i: c for i, c in enumerate(cols)}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in names.items()]))
    times = F.col(weight) if weight else F.lit(1)
    counted = (df.select(pairs.alias("p"), times.cast("long").alias("w")).select("p.c", "p.v", "w").where(F.col("v").isNotNull())
               .groupBy("c", "v").agg(F.sum("w").alias("n")).where("n > 0"))
    ranked = positions(counted, "c", "v", "v", sums=["n"])
    total = ranked.groupBy("c").agg(F.max("_cum_n").alias("_total"))                     # one row per column
    at = [(F.col("_total") - 1) * F.lit(p) for p in ps]
    pick = []
    for i, pos in enumerate(at):
        pick.append(F.min(F.when(F.col("_cum_n") > F.floor(pos), F.col("v"))).alias(f"lo{i}"))
        pick.append(F.min(F.when(F.col("_cum_n") > F.ceil(pos), F.col("v"))).alias(f"hi{i}"))
    rows = ranked.join(F.broadcast(total), "c").groupBy("c", "_total").agg(*pick).collect()
    out = {c: [None] * len(ps) for c in cols}
    for r in rows:
        for i, p in enumerate(ps):
            pos = (r["_total"] - 1) * p
            low, high = math.floor(pos), math.ceil(pos)
            lo, hi = r[f"lo{i}"], r[f"hi{i}"]
            out[names[r["c"]]][i] = lo if low == high or lo == hi else (high - pos) * lo + (pos - low) * hi
    return out


def robust_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """-> params table ``(feature, center, scale)``: median and IQR (IQR 0 -> 1)."""
    q = quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = []
    for c in cols:
        q25, med, q75 = q[c]
        iqr = None if q25 is None else q75 - q25
        rows.append((c, med, 1.0 if not iqr else iqr))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "feature string, center double, scale double")


def params_dict(params: DataFrame) -> dict:
    return {r["feature"]: (r["center"], r["scale"]) for r in params.collect()}


def robust_transform(df: DataFrame, params, suffix: str = "") -> DataFrame:
    """(x - median) / IQR per fitted column; NULL stays NULL."""
    p = params if isinstance(params, dict) else params_dict(params)
    out = df
    for c, (center, scale) in p.items():
        if c in out.columns:
            v = (F.col(c).cast("double") - F.lit(center if center is not None else 0.0)) / F.lit(scale)
            out = out.withColumn(c + suffix, v)
    return out


def robust_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return robust_transform(df, robust_fit(df, cols))


def minmax_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """-> one-row-per-column params ``(feature, lo, hi)`` from the training rows."""
    row = train.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in cols],
                    *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in cols]).first()
    rows = [(c, row[f"{c}__lo"], row[f"{c}__hi"]) for c in cols]
    return train.sparkSession.createDataFrame(rows, "feature string, lo double, hi double")


def minmax_transform(df: DataFrame, params: DataFrame) -> DataFrame:
    """F21 with stored training min/max; a zero range gives NULL (not 0/0)."""
    from netsleuth.functions.scalar import minmax
    out = df
    for r in params.collect():
        c = r["feature"]
        out = out.withColumn(c, minmax(F.col(c).cast("double"), F.lit(r["lo"]), F.lit(r["hi"])))
    return out
