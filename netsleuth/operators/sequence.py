"""Ordered-sequence building blocks that stay bounded under key skew.

A plain ``Window.partitionBy(src)`` puts every row of a source in one task; a
single noisy source can own a third of all rows.  These helpers split the
per-key sequence into time chunks, so no task ever holds more than one chunk
of one key, and stitch the chunks back together exactly:

* ``positions``     – 0-based rank of each row inside its key (by time, tie
                      column), plus running sums of indicator columns;
* ``lookback``      – values of the row ``k`` positions earlier (equi-join on
                      ``(key, position)``, which spreads a hot key over all
                      partitions);
* ``trailing_count``– number of rows of the same key in ``(t - width, t]``
                      (each row also visits the next bucket as a halo copy);
* ``global_prefix`` – running totals over a column with no partition key at
                      all (range partitions, prefix over their totals, then
                      inside them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netsleuth.functions.clock import micros

DEFAULT_CHUNK_MICROS = 60 * 1_000_000     # one minute of one key per task at most
_NULL_CHUNK = -(2 ** 62)                   # NULL times sort first, in one chunk


def _chunk(ts_col: str, chunk_micros: int) -> F.Column:
    return F.coalesce(F.floor(micros(ts_col) / F.lit(chunk_micros)), F.lit(_NULL_CHUNK).cast("bigint"))


def positions(df: DataFrame, key: str, ts_col: str, tie_col: str,
              sums: Sequence[str] = (), chunk_micros: int = DEFAULT_CHUNK_MICROS,
              pos_col: str = "_pos", method: str = "range", parts: int | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based rank within ``key`` ordered by ``ts_col`` NULLS
    FIRST, ``tie_col``) and ``_cum_<c>`` (inclusive running sum) per column in
    ``sums``.

    The sequence of every key is cut into chunks, ranked inside each chunk
    (windows partitioned by ``(key, chunk)``), and each chunk gets its offset
    from a prefix over a small per-chunk table (one row per key and chunk).

    ``method="range"`` (default): chunks are the partitions of
    ``repartitionByRange(key, time, tie)``, whose sampled boundaries split a
    hot key over many partitions, so no chunk exceeds one partition whatever
    the key's rate.  Each partition is sorted where it lies and ranked in one
    pass, and written with its number, so all consumers see identical chunks even
    after a retry and the rows are not shuffled again for a window.
    ``method="time"``: chunks are fixed time slices (``chunk_micros``), one
    shuffle cheaper, bounded by one key's rows per slice.
    """
    if method == "range":
        from netsleuth.session import written
        spark = df.sparkSession
        n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                         spark.sparkContext.defaultParallelism)
        ranged = df.repartitionByRange(n, F.col(key).asc_nulls_first(), F.col(ts_col).asc_nulls_first(),
                                       F.col(tie_col).asc_nulls_first())
        ranged = (ranged.sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(ts_col).asc_nulls_first(), F.col(tie_col).asc_nulls_first())
                  .withColumns({"_chunk": F.spark_partition_id().cast("bigint"), **{f"_lcum_{c}": F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in sums}}))
        schema = StructType([*ranged.schema.fields, StructField("_local", LongType())])
        d = written(ranged.mapInArrow(_ranks(key, [f"_lcum_{c}" for c in sums]), schema), "positions")
    else:
        d = df.withColumn("_chunk", _chunk(ts_col, chunk_micros))
        order = [F.col(ts_col).asc_nulls_first(), F.col(tie_col).asc_nulls_first()]
        w_local = Window.partitionBy(key, "_chunk").orderBy(*order)
        w_run = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("_local", F.row_number().over(w_local) - 1)
        for c in sums:
            d = d.withColumn(f"_lcum_{c}", F.sum(F.col(c)).over(w_run))

    per_chunk = d.groupBy(key, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c)).alias(f"_tot_{c}") for c in sums])
    w_prev = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        key, "_chunk", F.coalesce(F.sum("_n").over(w_prev), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_prev), F.lit(0)).alias(f"_off_{c}") for c in sums])

    offsets = offsets.withColumnRenamed(key, "_ok").withColumnRenamed("_chunk", "_oc")
    same = d[key].eqNullSafe(offsets["_ok"]) & (d["_chunk"] == offsets["_oc"])      # rows without key are a key of their own
    out = d.join(offsets, same, "inner").drop("_ok", "_oc").withColumn(pos_col, F.col("_off") + F.col("_local"))
    for c in sums:
        out = out.withColumn(f"_cum_{c}", F.col(f"_off_{c}") + F.col(f"_lcum_{c}"))
    drop = ["_chunk", "_local", "_off"] + [f"_lcum_{c}" for c in sums] + [f"_off_{c}" for c in sums]
    return out.drop(*drop)


def _ranks(key: str, sums: Sequence[str]):
    """Batches of a sorted partition -> with ``_local``, the rank of each row
    among the partition's rows of its key, and running sums in place of ``sums``."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        last, carry = None, [0] * (1 + len(sums))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            code = b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.concatenate([[last != (b.column(key)[0].as_py(),)], code[1:] != code[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))          # -1: goes on from the batch before
            out = []
            for i, v in enumerate([np.ones(n, np.int64), *(b.column(c).to_numpy(zero_copy_only=False) for c in sums)]):
                upto = np.cumsum(v)
                upto = upto - np.where(begin >= 0, (upto - v)[begin], -carry[i])
                carry[i] = int(upto[-1])
                out.append(upto)
            last = (b.column(key)[n - 1].as_py(),)
            names = b.schema.names
            cols = [pa.array(out[1 + list(sums).index(c)]) if c in sums else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out[0] - 1)], [*names, "_local"])
    return run


def lookback(df: DataFrame, key: str, target, values: Sequence[str], pos_col: str = "_pos",
             prefix: str = "_lag_") -> DataFrame:
    """Attach ``values`` of the row of the same key whose position equals the
    ``target`` expression (NULL when there is none), e.g. ``_pos - 20``.

    An equi-join on ``(key, position)``: the position spreads a hot key over
    all partitions."""
    lagged = df.select(F.col(key).alias("_lk"), F.col(pos_col).alias("_lp"),
                       *[F.col(v).alias(f"{prefix}{v}") for v in values])
    d = df.withColumn("_target", target)
    cond = d[key].eqNullSafe(lagged["_lk"]) & (d["_target"] == lagged["_lp"])
    return d.join(lagged, cond, "left").drop("_lk", "_lp", "_target")


def trailing_count(df: DataFrame, key: str, ts_col: str, width_micros: int,
                   out_col: str, null_value: int = 0, method: str = "bucket",
                   id_col: str | None = None) -> DataFrame:
    """Rows of the same key with time in ``(t - width, t]`` (ties included),
    for every row; NULL time -> ``null_value``.

    ``method="bucket"``: each row goes to its own ``width`` bucket and, as a
    halo copy carrying only key and time, to the next bucket.  A RANGE window
    per ``(key, bucket)`` then sees every row that can fall in the frame, so
    the count is exact while a task holds at most two buckets of one key.

    ``method="range"`` (needs a unique ``id_col``): C(x) = rows of the key with
    time <= x is read off ``positions`` at two probes per row, x = t and
    x = t - width, that sort after the data rows of equal time; the count is
    C(t) - C(t - width).  Every task holds at most one range partition, even
    inside a burst.
    """
    if method == "range":
        return _trailing_count_ranked(df, key, ts_col, width_micros, out_col, null_value, id_col)
    t = micros(ts_col)
    base = df.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / F.lit(width_micros))) \
             .withColumn("_halo", F.lit(False))
    halo = base.where(F.col("_t").isNotNull()).select(
        F.col(key), F.col("_t"), (F.col("_b") + 1).alias("_b"), F.lit(True).alias("_halo"))
    both = base.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-(width_micros - 1), 0)
    counted = both.withColumn(out_col, F.count(F.lit(1)).over(w))
    out = counted.where(~F.col("_halo"))
    out = out.withColumn(out_col, F.when(F.col("_t").isNull(), F.lit(null_value)).otherwise(F.col(out_col)))
    return out.drop("_t", "_b", "_halo")


def _trailing_count_ranked(df: DataFrame, key: str, ts_col: str, width_micros: int, out_col: str,
                           null_value: int, id_col: str | None) -> DataFrame:
    if id_col is None:
        raise ValueError("method='range' needs a unique id column")
    t = micros(ts_col)
    timed = df.where(F.col(ts_col).isNotNull()).select(F.col(key), t.alias("_x"), F.col(id_col).alias("_id"))
    data = timed.select(key, "_x", F.struct(F.lit(0).alias("k"), F.col("_id").alias("i")).alias("_tie"),
                        F.lit(1).alias("_is_data"), F.lit(None).cast(timed.schema["_id"].dataType).alias("_qid"),
                        F.lit(None).cast("int").alias("_side"))
    probes = timed.select(key, F.explode(F.array(
        F.struct(F.col("_x").alias("x"), F.lit(1).alias("side")),
        F.struct((F.col("_x") - F.lit(width_micros)).alias("x"), F.lit(0).alias("side")))).alias("p"), "_id") \
        .select(key, F.col("p.x").alias("_x"), F.struct(F.lit(1).alias("k"), F.col("_id").alias("i"),
                                                        F.col("p.side").alias("s")).alias("_tie"),
                F.lit(0).alias("_is_data"), F.col("_id").alias("_qid"), F.col("p.side").alias("_side"))
    data = data.withColumn("_tie", F.struct(F.col("_tie.k"), F.col("_tie.i"), F.lit(0).alias("s")))
    ranked = positions(data.unionByName(probes), key, "_x", "_tie", sums=["_is_data"])
    c = ranked.where(F.col("_is_data") == 0).groupBy("_qid").agg(
        (F.max(F.when(F.col("_side") == 1, F.col("_cum__is_data")))
         - F.max(F.when(F.col("_side") == 0, F.col("_cum__is_data")))).alias(out_col))
    out = df.join(c, df[id_col] == c["_qid"], "left").drop("_qid")
    return out.withColumn(out_col, F.when(F.col(ts_col).isNull(), F.lit(null_value).cast("long"))
                          .otherwise(F.coalesce(F.col(out_col).cast("long"), F.lit(null_value).cast("long"))))


def ordered_counts(df: DataFrame, key: str, ts_col: str, tie_col: str, width_micros: int,
                   sums: Sequence[str] = ()) -> DataFrame:
    """Everything the ordered features need, from one ranked pass over the
    narrow columns ``(key, time, tie)``.

    -> ``(key, _x, tie, _pos, _in_width, _cum_<c>...)`` per row: the time in
    microseconds, the position inside the key, and the rows of the key in
    ``(t - width, t]``.  Each distinct (key, time) adds one probe row at
    ``t - width`` that sorts behind the rows of equal time; counts at a time are
    the running counts at its last row, so peers see each other."""
    data = df.select(F.col(key), micros(ts_col).alias("_x"), F.lit(0).alias("_k"), F.col(tie_col).alias("_id"),
                     F.lit(1).alias("_one"), *[F.col(c) for c in sums])
    probe = (data.where(F.col("_x").isNotNull()).select(key, "_x").distinct()
             .select(F.col(key), (F.col("_x") - F.lit(width_micros)).alias("_x"), F.lit(1).alias("_k"),
                     F.lit(None).cast(data.schema["_id"].dataType).alias("_id"), F.lit(0).alias("_one"),
                     *[F.lit(0).cast(data.schema[c].dataType).alias(c) for c in sums]))
    order = F.struct("_k", "_id")
    ranked = positions(data.unionByName(probe).withColumn("_tie", order), key, "_x", "_tie", sums=["_one", *sums])
    at = F.when(F.col("_k") == 0, F.col("_x")).otherwise(F.col("_x") + F.lit(width_micros))
    counts = (ranked.where(F.col("_x").isNotNull()).groupBy(F.col(key).alias("_gk"), at.alias("_gx"))
              .agg((F.max(F.when(F.col("_k") == 0, F.col("_cum__one"))) - F.max(F.when(F.col("_k") == 1, F.col("_cum__one"))))
                   .alias("_in_width")))
    rows = ranked.where(F.col("_k") == 0)
    same = rows[key].eqNullSafe(counts["_gk"]) & (rows["_x"] == counts["_gx"])
    return (rows.join(counts, same, "left")
            .select(key, "_x", F.col("_id").alias(tie_col), (F.col("_cum__one") - 1).alias("_pos"),
                    F.coalesce("_in_width", F.lit(0)).cast("long").alias("_in_width"), *[f"_cum_{c}" for c in sums]))


def global_prefix(df: DataFrame, order_col: str, sums: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """Inclusive running sums ``_cum_<c>`` over ``order_col`` (ascending; values
    assumed distinct, e.g. an already grouped table) without a single-partition
    window.

    Rows are cut into as many ranges of ``order_col`` as shuffle partitions
    (unless ``n_buckets`` says otherwise); a row's range is the partition it
    lies in, frozen by a checkpoint.  Totals per range are prefixed over the
    table of ranges, and each range is prefixed in its own task.
    """
    from netsleuth.session import materialize
    n_buckets = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = materialize(df.repartitionByRange(n_buckets, order_col).withColumn("_bk", F.spark_partition_id()))
    tot = d.groupBy("_bk").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sums])
    wprev = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_bk", *[F.coalesce(F.sum(f"_bt_{c}").over(wprev), F.lit(0)).alias(f"_bo_{c}") for c in sums])
    win = Window.partitionBy("_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sums:
        d = d.withColumn(f"_bl_{c}", F.sum(c).over(win))
    d = d.join(F.broadcast(offs), "_bk", "inner")   # one row per range: n_buckets rows at most
    for c in sums:
        d = d.withColumn(f"_cum_{c}", F.col(f"_bo_{c}") + F.col(f"_bl_{c}"))
    return d.drop("_bk", *[f"_bl_{c}" for c in sums], *[f"_bo_{c}" for c in sums])
