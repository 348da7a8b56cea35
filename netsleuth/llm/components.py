"""Connected components of an edge table by alternating large-star and
small-star steps (a fixed number of shuffles per round, rounds grow with the
logarithm of the longest path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.util import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    kids = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kids.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u long, v long)``.

    ``root`` is the smallest node of the component.  Isolated nodes do not
    occur; loops and repeated edges are ignored; an empty table gives an empty
    one."""
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), f"{name}-0")
    seen, turn = _mark(now), 0
    while seen[0]:
        turn += 1
        now = settle(_small_star(_large_star(now)), f"{name}-{turn}")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
