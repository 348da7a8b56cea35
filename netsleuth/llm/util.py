"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.session import scratch_path


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker.

    Worker functions travel by value, so a module global would be rebuilt for
    every task; compiled tables and word caches are kept here instead."""
    mod = sys.modules.get("_netsleuth_worker_cache")
    if mod is None:
        mod = types.ModuleType("_netsleuth_worker_cache")
        mod.data = {}
        sys.modules["_netsleuth_worker_cache"] = mod
    return mod.data


def settle(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that every executor can read, so a lost
    executor never sends the job back to the scan, and later readers prune
    columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_rid, doc_id, text)`` of a stored table.

    ``_rid`` numbers the rows by scan partition and place, so repeated and null
    ids stay apart; it is the same each time the same files are scanned."""
    return docs.select(F.monotonically_increasing_id().alias("_rid"),
                       F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def as_bytes(column) -> list:
    """UTF-8 bytes (or None) of an Arrow string column, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def table_partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Keys with more than one in so many of the rows are joined apart.
HEAVY_SHARE = 10_000


def join_counted(facts: DataFrame, keys: DataFrame, on: str | list[str], n_col: str) -> DataFrame:
    """Inner join of ``facts`` to ``keys``, which holds a key once and in
    ``n_col`` the number of its rows in ``facts``.

    Keys that hold more than 1/``HEAVY_SHARE`` of the rows, so fewer than
    ``HEAVY_SHARE`` keys, are broadcast; the others are joined by shuffle, where
    none of them is hot.  Both tables are read twice: pass stored ones."""
    total = keys.agg(F.sum(n_col)).first()[0] or 0
    limit = max(total // HEAVY_SHARE, 100)
    heavy = F.broadcast(keys.where(F.col(n_col) > limit).drop(n_col))
    light = keys.where(F.col(n_col) <= limit).drop(n_col)
    rest = facts.join(heavy.select(*([on] if isinstance(on, str) else on)), on, "left_anti")
    return facts.join(heavy, on).unionByName(rest.join(light, on))


def joined_sha256(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """``(key, n, sha256)``: the texts of each key in the order of ``order``,
    joined by commas, as lower-case hexadecimal SHA-256, and their number.

    ``rows`` is stored and has no null.  Rows are dealt by ranges of (key,
    order), so that a hot key is spread, and leave each task as pieces; only
    the pieces of a key meet, one after the other, in a running digest."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}[key]

    def pieces(batches):
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 32, 0
        held, parts, size = None, [], 0
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            out = []
            for k, t in zip(keys.to_pylist(), texts):
                if k != held or size > 1 << 18:
                    if parts:
                        out.append((held, base + seq, len(parts), ",".join(parts)))
                        seq += 1
                    held, parts, size = k, [], 0
                parts.append(t)
                size += len(t) + 1
            yield batch(out, keys.type)
        if parts:
            yield batch([(held, base + seq, len(parts), ",".join(parts))], keys.type)

    def batch(out, key_type):
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [key_type, pa.int64(), pa.int64(), pa.string()])],
                                          [key, "piece", "n", "text"])

    def digests(batches):
        import hashlib
        held, state, n, first, kind_ = None, None, 0, True, None
        for b in batches:
            out = []
            kind_ = b.column(0).type
            for k, m, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if first or k != held:
                    if not first:
                        out.append((held, n, state.hexdigest()))
                    held, state, n, first = k, hashlib.sha256(), 0, False
                elif n:
                    state.update(b",")
                state.update(t.encode())
                n += m
            yield final(out, kind_)
        if not first:
            yield final([(held, n, state.hexdigest())], kind_)

    def final(out, key_type):
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [key_type, pa.int64(), pa.string()])], [key, "n", "sha256"])

    cut = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).select(key, F.col(text).alias("text")) \
        .mapInArrow(pieces, f"{key} {kind}, piece long, n long, text string")
    return cut.repartition(key).sortWithinPartitions(key, "piece").mapInArrow(digests, f"{key} {kind}, n long, sha256 string")
